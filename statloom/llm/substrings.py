"""Removal of passages that the corpus repeats: fingerprints confirm them, sharded Aho-Corasick automata find every occurrence.

A window is ``WINDOW`` consecutive words of one document; words covered by a window whose words also start elsewhere go.

1. Each window has an anchor: the smallest hash of the ``GRAM``-word runs in it (the leftmost of equals). Equal windows have equal
   anchors. Consecutive windows with one anchor form a span, about one for every fifteen words; only spans are shuffled.
2. An anchor seen once holds no recurring window. The others' words are cut out of every document as pieces (anchor, words).
3. Recurring passages are confirmed as phrases of ``WINDOW`` words or more, each kept once. Where all spans of an anchor are equal, or a
   span comes twice, one of them speaks: its words are a phrase. In the other spans windows are counted one by one, and the words of
   each run of recurring ones are a phrase.
4. Phrases are sharded by anchor into blocks of at most ``PHRASES``; each block is compiled into an automaton over words, and the pieces
   of all documents with the block's anchors are streamed through it. Its hits, and nothing else, say which words go. Phrases and
   pieces are compared word by word, not by hash.

Anchors with very many pieces or phrases are dealt out as blocks of pieces times blocks of phrases, so no task gathers a hot
passage. Aggregates are partial, and AQE may split the hot keys of joins. Texts are shuffled compressed. Rows are named by two hashes,
of doc_id (or text) and text; windows and spans are compared by 64-bit hashes within one anchor, itself a 64-bit hash.

Defined cases: null and empty texts have no words; a row repeated with id and text is an occurrence of its own, so both lose all
windows; a window may overlap its own repeat; a null doc_id is a document; an empty table gives no rows; columns of any name
may follow, also those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inputs import discard, per_batch, release, row_key, written
from .textkernel import chunks, covered, inside_document, long_column, ragged, span_hashes, split_words, window_hashes, winnow

WINDOW = 35
GRAM = 6
#: Phrases in an automaton, and pieces that meet it in one task (both on average: they are dealt by hash).
PHRASES, PIECES = 8192, 65536

U64 = np.uint64


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def compressed(docs: DataFrame, text: str, packed: str) -> DataFrame:
    """Replace the text column by its compressed bytes; null stays null."""
    at = docs.columns.index(text)
    schema = T.StructType([T.StructField(packed, T.BinaryType()) if i == at else f for i, f in enumerate(docs.schema)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = _zstd()[0].compress
        column = pa.array([None if not x.is_valid else pack(x.as_buffer()) for x in batch.column(at)], pa.binary())
        return pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], names=schema.names)

    return per_batch(docs, work, schema)


def opened(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of slices of a compressed column, so that few texts are open at a time."""
    unpack = _zstd()[1].decompress
    rows, size, first = [], 0, 0
    for i, x in enumerate(column):
        rows.append(None if not x.is_valid else unpack(x.as_buffer()))
        size += len(rows[-1] or b"")
        if size > 1 << 20 or i == len(column) - 1:
            yield first, pa.array(rows, pa.large_binary()).cast(pa.large_string())
            rows, size, first = [], 0, i + 1


def spans_of(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, anchor hash and hash of all words of each span."""
    windows = np.flatnonzero(inside_document(doc, window))
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64)
    grams = window_hashes(hashes, gram)
    at = winnow(grams, window - gram + 1)[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    start = windows[first]
    n = windows[last] - start + 1
    return start, n, grams[at[first]], span_hashes(hashes, start, start + n - 1 + window)


def find_spans(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, span, _k1, _k2, place (start * 64 + windows) for the spans of rows (_k1, _k2, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for row, _, data, offsets in chunks(batch.column(2)):
            words = split_words(data, offsets)
            start, n, anchor, span = spans_of(words.hashes(), words.doc, window, gram)
            doc = words.doc[start]
            for out, x in zip(columns, (anchor.view(np.int64), span.view(np.int64), doc + row, (start - words.first[doc]) * 64 + n), strict=True):
                out.append(x)
        anchor, span, rows, place = map(np.concatenate, columns)
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(span), batch.column(0).take(rows), batch.column(1).take(rows), long_column(place)], names=["anchor", "span", "_k1", "_k2", "place"])

    return per_batch(keyed, work, "anchor long, span long, _k1 long, _k2 long, place long")


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges of data as a binary column."""
    size = end - begin
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[ragged(begin, size)])])


def cut_pieces(keyed: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """anchor, kind, _k1, _k2, start, n, words: the words of each span of ``recurring`` (anchor, kind, _k1, _k2, place) in each row."""
    asked = written(recurring.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("place", "anchor", "kind")).alias("asked")), "asked")
    texts = compressed(keyed, "text", "packed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    yield from cut(whole.slice(at, 256))
        finally:
            release()

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, texts in opened(batch.column(2)):
            for row, stop, data, offsets in chunks(texts):
                words = split_words(data, offsets)
                lists = batch.column(3).slice(first + row, stop - row)
                fields = lists.flatten()
                doc = np.repeat(np.arange(stop - row), np.diff(lists.offsets.to_numpy()))
                place = fields.field("place").to_numpy()
                start, n = place >> 6, place & 63
                begin = words.first[doc] + start
                rows = pa.array(doc + first + row)
                yield pa.RecordBatch.from_arrays(
                    [fields.field("anchor"), fields.field("kind"), batch.column(0).take(rows), batch.column(1).take(rows), long_column(start), pa.array(n.astype(np.int32)), _slices(data, words.start[begin], words.end[begin + n + window - 2])],
                    names=["anchor", "kind", "_k1", "_k2", "start", "n", "words"],
                )

    joined = texts.join(asked, ["_k1", "_k2"]).select("_k1", "_k2", "packed", "asked")
    pieces = written(joined.mapInArrow(work, "anchor long, kind int, _k1 long, _k2 long, start long, n int, words binary"), "pieces")
    discard(asked)
    return pieces


#: What a span is to the search: one of several equal ones, the one that speaks for them, or one whose windows are counted.
COPY, SPEAKER, SINGLE = 0, 1, 2


def _pieces_and_phrases(keyed: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The pieces with recurring anchors, and the phrases (anchor, words) that are confirmed to recur."""
    spans = find_spans(keyed, window, gram)
    name = F.xxhash64("_k1", "_k2", "place")  # should two share one, both speak, which changes nothing
    anchors = spans.groupBy("anchor").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high"), F.min(name).alias("first")).where("n > 1")
    # aggregates are written before they are joined: AQE splits the hot keys of a join only between plain exchanges
    anchors = written(anchors.select("anchor", (F.col("low") == F.col("high")).alias("same"), "first"), "anchors")
    seen = written(spans.join(anchors, "anchor"), "spans")
    own = name == F.col("first")
    same = seen.where("same").select("anchor", F.when(own, SPEAKER).otherwise(COPY).alias("kind"), "_k1", "_k2", "place")
    mixed = seen.where("not same").drop("first")
    per_span = written(mixed.groupBy("anchor", "span").agg(F.count("*").alias("copies"), F.min(name).alias("first")), "copies")
    mixed = mixed.join(per_span, ["anchor", "span"])
    mixed = mixed.select("anchor", F.when(F.col("copies") == 1, SINGLE + 4).when(own, SPEAKER + 4).otherwise(COPY + 4).alias("kind"), "_k1", "_k2", "place")
    pieces = cut_pieces(keyed, same.unionByName(mixed), window)
    discard(anchors, seen, per_span)

    # windows of the anchors whose spans differ: those of a single span weigh one, those of a speaker two
    def windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(*_bytes(batch.column(6)))
        n = batch.column(5).to_numpy().astype(np.int64)
        piece = np.repeat(np.arange(batch.num_rows), n)
        at = ragged(words.first[:-1], n)
        value = window_hashes(words.hashes(), window)[at]
        rows = pa.array(piece)
        start = batch.column(4).to_numpy()[piece]
        weight = np.where(batch.column(1).to_numpy() & 3 == SINGLE, 1, 2).astype(np.int32)[piece]
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(value.view(np.int64)), batch.column(2).take(rows), batch.column(3).take(rows), long_column(start * 64 + at - words.first[piece]), pa.array(weight)], names=["anchor", "value", "_k1", "_k2", "place", "weight"])

    counted = written(per_batch(pieces.where(f"kind in ({SPEAKER + 4}, {SINGLE + 4})"), windows_of, "anchor long, value long, _k1 long, _k2 long, place long, weight int"), "windows")
    twice = written(counted.groupBy("anchor", "value").agg(F.sum("weight").alias("weight")).where("weight > 1").select("anchor", "value"), "twice")
    single = counted.where("weight = 1").join(twice, ["anchor", "value"]).select("anchor", "_k1", "_k2", F.shiftright("place", 6).alias("start"), F.col("place").bitwiseAND(63).cast("int").alias("i"))
    runs = written(single.groupBy("anchor", "_k1", "_k2", "start").agg(F.collect_list("i").alias("recurring")), "runs")
    discard(counted, twice)
    spoken = pieces.where(f"kind in ({SPEAKER}, {SPEAKER + 4})").select("anchor", "words")
    partly = pieces.where(f"kind = {SINGLE + 4}").join(runs, ["anchor", "_k1", "_k2", "start"]).select("anchor", "words", "recurring")

    def runs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _bytes(batch.column(1))
        words, lists = split_words(data, offsets), batch.column(2)
        at = np.sort(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())) * 64 + lists.flatten().to_numpy())
        gap = np.diff(at) > 1  # the last window of a piece and the first of the next are never neighbours: a span has 63 at most
        first, last = at[np.append(True, gap)], at[np.append(gap, True)]
        piece = first >> 6
        begin, end = words.first[piece] + (first & 63), words.first[piece] + (last & 63) + window - 1
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(piece)), _slices(data, words.start[begin], words.end[end])], names=["anchor", "words"])

    phrases = spoken.unionByName(per_batch(partly, runs_of, "anchor long, words binary"))
    phrases = written(phrases.dropDuplicates(["anchor", "words"]), "phrases")
    discard(runs)
    return pieces, phrases


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


def compiled(phrases: list[bytes]) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """An automaton over phrases with one sign for each word, and the signs: exact, as each word of the phrases has its own."""
    signs: dict[bytes, int] = {}
    split = [p.split() for p in phrases]
    for words in split:
        for w in words:
            signs.setdefault(w, len(signs) + 1)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for words in split:
        automaton.add_word(_signs([signs[w] for w in words]))
    automaton.make_automaton()
    return automaton, signs


def _signs(codes: list[int]) -> str:
    """A string with a sign for each number; those of surrogates are left out."""
    codes = np.array(codes, np.uint32)
    return (codes + np.where(codes < 0xD000, 0, 0x1000).astype(np.uint32)).astype("<u4").tobytes().decode("utf-32-le")


def locate(phrases: list[bytes], pieces: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first word, last word) of what the hits of each piece cover together: they are at least ``window`` words each, and a piece
    has fewer than twice as many, so they overlap and cover one range. Pieces that are equal are streamed once."""
    automaton, signs = compiled(phrases)
    same = pieces.dictionary_encode()
    distinct, code = same.dictionary, same.indices.to_numpy()
    low, high = np.full(len(distinct), 1 << 30), np.full(len(distinct), -1)
    get = signs.get
    for row in range(0, len(distinct), 2048):
        raw = [x.as_py().split() for x in distinct.slice(row, 2048)]
        first = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        hits = np.array(list(automaton.iter(_signs([get(w, 0) for words in raw for w in words]))), np.int64).reshape(-1, 2)
        last, start = hits[:, 0], hits[:, 0] - hits[:, 1] + 1
        piece = np.searchsorted(first, start, "right") - 1
        inside = last < first[piece + 1]  # a hit across two pieces is none
        start, last, piece = start[inside], last[inside], piece[inside]
        np.minimum.at(low, piece + row, start - first[piece])
        np.maximum.at(high, piece + row, last - first[piece])
    found = np.flatnonzero(high[code] >= 0)
    return found, low[code[found]], high[code[found]]


def occurrences(pieces: DataFrame, phrases: DataFrame, window: int = WINDOW, most_phrases: int = PHRASES, most_pieces: int = PIECES) -> DataFrame:
    """_k1, _k2, start, n: ranges of words that phrases cover, found by streaming all pieces through the shards' automata."""
    shards = max(1, -(-phrases.count() // most_phrases))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    # a shard is cut into blocks of phrases and blocks of pieces where an anchor makes it large
    blocks = phrases.groupBy(shard).agg(F.ceil(F.count("*") / (2 * most_phrases)).cast("int").alias("blocks"))
    deals = pieces.groupBy(shard).agg(F.ceil(F.count("*") / most_pieces).cast("int").alias("deals"))
    plan = written(blocks.join(deals, "shard"), "shards")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = phrases.select(shard, "words").join(plan, "shard").select("shard", F.pmod(F.xxhash64("words"), F.col("blocks")).cast("int").alias("block"), every("deals").alias("deal"), "words")
    # a salt of the written table's rows deals pieces of equal rows evenly; an attempt that runs again reads the same salts
    streamed = pieces.select(shard, "_k1", "_k2", "start", "words", F.monotonically_increasing_id().alias("salt")).join(plan, "shard")
    streamed = streamed.select("shard", every("blocks").alias("block"), F.pmod(F.xxhash64("_k1", "_k2", "start", "salt"), F.col("deals")).cast("int").alias("deal"), "_k1", "_k2", "start", "words")

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        piece, first, last = locate(own.column("words").to_pylist(), asked.column("words").combine_chunks(), window) if own.num_rows and asked.num_rows else (none,) * 3
        rows = pa.array(piece)
        start = asked.column("start").take(rows).to_numpy() + first
        out = pa.table({"_k1": asked.column("_k1").take(rows), "_k2": asked.column("_k2").take(rows), "start": long_column(start), "n": long_column(last - first + 1)})
        release()
        return out

    cell = ["shard", "block", "deal"]
    return known.groupBy(*cell).cogroup(streamed.groupBy(*cell)).applyInArrow(search, "_k1 long, _k2 long, start long, n long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """The rows of docs with all their columns, text as it was, and _n_words, _n_removed, _kept (the kept words with single spaces)."""
    if window - gram + 1 > min(63, window):
        raise ValueError("a span may have 63 windows at most")
    keyed = docs.select(F.struct("*").alias("_row"), *row_key(F.col("doc_id"), F.col("text")), F.col("text"))
    pieces, phrases = _pieces_and_phrases(keyed.select("_k1", "_k2", "text"), window, gram)
    ranges = occurrences(pieces, phrases, window, **options).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "n")).alias("_ranges"))
    # text is wanted once: the row keeps its place, and the text itself goes compressed
    packed = keyed.withColumn("_row", F.col("_row").dropFields("text")) if len(docs.columns) > 1 else keyed
    packed = compressed(packed, "text", "text").join(written(ranges, "ranges"), ["_k1", "_k2"], "left").select("_row", "text", "_ranges")
    schema = T.StructType([T.StructField("_row", packed.schema["_row"].dataType), T.StructField("text", T.StringType()), *[T.StructField(n, t) for n, t in (("_n_words", T.LongType()), ("_n_removed", T.LongType()), ("_kept", T.StringType()))]])

    def work(batch: pa.RecordBatch):
        for first_row, texts in opened(batch.column(1)):
            for row, stop, data, offsets in chunks(texts):
                words = split_words(data, offsets)
                begin, size = [], []
                for i in range(row, stop):
                    for x in batch.column(2)[first_row + i].as_py() or ():
                        begin.append(words.first[i - row] + x["start"]), size.append(x["n"])
                hit = covered(np.array(begin, np.int64), np.array(size, np.int64), len(words.doc))
                raw = data.tobytes()
                kept = []
                for i in range(stop - row):
                    own = raw[offsets[i] : offsets[i + 1]].split()
                    gone = hit[words.first[i] : words.first[i + 1]]
                    kept.append(b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g] if gone.any() else own))
                removed = np.bincount(words.doc[hit], minlength=words.n_docs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first_row + row, stop - row), texts.slice(row, stop - row).cast(pa.string()), long_column(words.counts()), long_column(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    def run(batches):
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    yield from work(batch.slice(at, 1024))
        finally:
            release()

    found = packed.mapInArrow(run, schema)
    return found.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns], "_n_words", "_n_removed", "_kept")


def repeat_digest(docs: DataFrame, **options) -> DataFrame:
    """The columns of the query."""
    found = remove_repeats(docs.select(F.col("doc_id").cast("long"), "text"), **options)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the same columns; a text that lost words is its kept words with single spaces, and n_chars follows if there is one."""
    found = remove_repeats(docs, **options)
    changed = F.col("_n_removed") > 0
    out = found.withColumn("text", F.when(changed, F.col("_kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
