"""Near-duplicate classes by b-bit MinHash.

Each document's set of word shingles gives ``BANDS`` x ``ROWS`` minima. Bands of minima find candidates; the low ``BITS`` bits of
all minima, packed into longs, estimate the similarity of a candidate pair by counting bits, corrected for chance collisions;
what may reach the threshold is confirmed on the full sets.

Documents with equal sets are one node. In a bucket (equal minima of a band) every member is paired with the bucket's smallest member
only, first with its best such partner, then with the others where the two are not yet joined. Buckets that still hold several
components are compared in blocks of ``BLOCK`` members, signature against signature, so no pair of different texts in a bucket
is left out, and no bucket is gathered in one task.

A pair at the threshold is missed with probability (1 - 0.75^5)^51, one in a million; at similarity 0.8 it is one in 10^9.

Rows are named by doc_id and the hash of their text, sets by a 64-bit hash, so the texts of a repeated doc_id are judged one by one.

Defined cases: documents without words have the empty set and are linked with nothing; rows without doc_id are linked with nothing
and keep component and ``kept`` null; every row that has the smallest doc_id of its class is ``kept``, repeated ones too.
``drop_near_duplicates`` links rows without doc_id like others and leaves one row of each class, that with the smallest doc_id, then
the smallest hash of its text; of rows with equal doc_id and text it leaves one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .inputs import discard, per_batch, row_key, written
from .substrings import compressed, opened
from .textkernel import LOWER, chunks, inside_document, long_column, mix, span_hashes, split_words, window_hashes

SHINGLE = 5
BANDS, ROWS, BITS = 51, 5, 2
PER_LONG = 64 // BITS
#: Members in a block of a bucket that is compared all against all.
BLOCK = 256
#: An estimate from 255 minima of 2 bits has a standard deviation of 0.04; five of them below the threshold is still checked.
MARGIN = 0.2

U64 = np.uint64
_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ROW_BASE = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their document, by document; a text of fewer words is one shingle."""
    words = split_words(LOWER[data], offsets)
    hashes = words.hashes()
    full = np.flatnonzero(inside_document(words.doc, k))
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < k))
    value = np.concatenate([window_hashes(hashes, k)[full], span_hashes(hashes, words.first[short], words.first[short + 1])])
    doc = np.concatenate([words.doc[full], short])
    key = mix(value + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    at = np.unique(key, return_index=True)[1]
    at = at[np.argsort(doc[at], kind="stable")]
    return value[at], doc[at]


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (128 bits that name the set), bands (a key per band), bits (packed low bits) of rows
    (doc_id, text, ...); further columns follow."""
    more = docs.schema.fields[2:]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, _, data, offsets in chunks(batch.column(1)):
            n = len(offsets) - 1
            value, doc = shingles(data, offsets, k)
            size = np.bincount(doc, minlength=n)
            some = np.flatnonzero(size)
            first = np.concatenate([[0], np.cumsum(size[some])])[:-1]
            names = np.zeros((2, n), U64)
            keys = np.zeros((n, BANDS), U64)
            packed = np.zeros((n, BANDS * ROWS // PER_LONG + 1), U64)
            if len(some):
                names[0, some] = np.add.reduceat(mix(value), first)
                names[1, some] = np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), first)
                low = (value >> U64(32)).astype(np.uint32)
                for i in range(BANDS * ROWS):
                    least = np.minimum.reduceat(low * _MULTIPLY[i] + _ADD[i], first).astype(U64)
                    keys[some, i // ROWS] += mix(least + U64(i)) * _ROW_BASE[i % ROWS]
                    packed[some, i // PER_LONG] |= (mix(least) & U64((1 << BITS) - 1)) << U64(BITS * (i % PER_LONG))
                keys = mix(keys + np.arange(BANDS, dtype=U64) * U64(0xD6E8FEB86659FD93))
            for column, x in zip(out, (size, names[0], names[1], keys, packed), strict=True):
                column.append(x)
        size, s1, s2, keys, packed = map(np.concatenate, out)
        rows = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), long_column(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), rows(keys), rows(packed), *batch.columns[2:]], names=["doc_id", "n_shingles", "s1", "s2", "bands", "bits", *[f.name for f in more]])

    return per_batch(docs, work, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, bits array<long>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more))


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two packed signatures speak for; equal bits by chance are taken off."""
    places = BANDS * ROWS
    fields = int("01" * PER_LONG, 2)
    unequal = lambda p, q: F.bit_count((p.bitwiseXOR(q)).bitwiseOR(F.shiftrightunsigned(p.bitwiseXOR(q), 1)).bitwiseAND(F.lit(fields)))
    different = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda total, x: total + x)
    chance = 2.0**-BITS
    return ((1 - different / places) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, linked: whether the full sets of each pair reach the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (row, shingle), and the set sizes."""
        keys, sizes = [], []
        for first, texts in opened(column):
            for row, _, data, offsets in chunks(texts):
                value, doc = shingles(data, offsets, k)
                sizes.append(np.bincount(doc, minlength=len(offsets) - 1))
                keys.append(mix(value + (doc + row + first).astype(U64) * U64(0x9E3779B97F4A7C15)))
        return np.concatenate(keys), np.concatenate(sizes)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = []
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            (x, n), (y, m) = sets(part.column(2)), sets(part.column(3))
            order = np.argsort(y)
            place = np.minimum(np.searchsorted(y, x, sorter=order), len(y) - 1)
            row = np.repeat(np.arange(part.num_rows), n)
            both = np.bincount(row[y[order[place]] == x], minlength=part.num_rows) if len(y) else np.zeros(part.num_rows, int)
            linked.append(100 * both >= percent * (n + m - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(linked))], names=["a", "b", "linked"])

    return per_batch(joined, compare, "a long, b long, linked boolean")


def _sorted_sets(packed: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each compressed text."""
    found: list[np.ndarray] = []
    for _, texts in opened(packed):
        for _, _, data, offsets in chunks(texts):
            value, doc = shingles(data, offsets, k)
            found += map(np.sort, np.split(value, np.searchsorted(doc, np.arange(1, len(offsets) - 1))))
    return found


def _near_partners(table: pa.Table, least: float) -> dict[int, np.ndarray]:
    """For rows of a pair of blocks, the rows of other components whose signatures are near enough. Each pair is met once."""
    own, outside = table.column("own").to_numpy(), table.column("outside").to_numpy()
    ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
    bits = table.column("bits").combine_chunks().flatten().to_numpy().view(U64).reshape(len(ids), -1)
    kind, one, two = (int(table.column(c)[0].as_py()) for c in ("kind", "x", "y"))
    if kind:
        rows, columns = np.flatnonzero(own == one), np.flatnonzero(own == two)
    else:
        rows, columns = np.flatnonzero(outside), np.flatnonzero(~outside)
    fields, chance = U64(int("01" * PER_LONG, 2)), 2.0**-BITS
    partners: dict[int, np.ndarray] = {}
    for i in rows.tolist():
        x = bits[columns] ^ bits[i]
        different = np.bitwise_count((x | x >> U64(1)) & fields).sum(1)
        near = ((1 - different / (BANDS * ROWS)) - chance) / (1 - chance) >= least
        partner = columns[near & (component[columns] != component[i])]
        if kind and one == two:
            partner = partner[ids[partner] > ids[i]]
        if len(partner):
            partners[i] = partner
    return partners


def _block_links(members: DataFrame, bits: DataFrame, texts: DataFrame, least: float, k: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket: (bucket, id, component) rows.

    A bucket's largest component is joined already: its members meet only the outsiders, and outsiders meet each other. Both
    sides are cut into blocks, so the rows grow with the bucket while it has few outsiders. Two blocks first compare their
    signatures, without texts; only members that came near another component get their texts, and the blocks confirm
    on the full sets and return one link for each member and component.
    """
    per_component = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = per_component.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("bucket", F.col("main.component").alias("main"), blocks(F.col("main.n")).alias("inner"), blocks(F.col("n") - F.col("main.n")).alias("outer"))
    sizes = written(sizes, "sizes")
    placed = members.join(sizes, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    own, outside = F.col("own"), F.col("outside")
    inside_places = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda j: F.struct(F.lit(0).alias("kind"), own.alias("x"), j.alias("y")))
    outside_places = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("x"), own.alias("y"))),
        F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least(own, j).alias("x"), F.greatest(own, j).alias("y"))),
    )
    dealt = placed.join(bits, "id").select("id", "component", "bucket", "own", "outside", "bits", F.explode(F.when(outside, outside_places).otherwise(inside_places)).alias("p"))
    dealt = dealt.select("id", "component", "bucket", "own", "outside", "bits", "p.kind", "p.x", "p.y")
    place = ["bucket", "kind", "x", "y"]

    def candidates(table: pa.Table) -> pa.Table:
        partners = _near_partners(table, least)
        used = np.unique(np.concatenate([list(partners), *partners.values()]).astype(np.int64)) if partners else np.zeros(0, np.int64)
        return table.take(pa.array(used)).select([*place, "id", "component", "own", "outside", "bits"])

    def compare(table: pa.Table) -> pa.Table:
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sets = _sorted_sets(table.column("text").combine_chunks(), k)
        for i, partner in _near_partners(table, least).items():
            partner = partner[[len(sets[j]) > 0 for j in partner.tolist()]]
            mine, others = sets[i], [sets[j] for j in partner.tolist()]
            if not len(mine) or not others:
                continue
            size = np.array([len(x) for x in others])
            together = np.concatenate(others)
            at = np.minimum(np.searchsorted(mine, together), len(mine) - 1)
            both = np.add.reduceat(mine[at] == together, np.cumsum(size) - size)
            linked = partner[100 * both >= percent * (len(mine) + size - both)]
            linked = linked[np.unique(component[linked], return_index=True)[1]]
            a.append(np.maximum(ids[linked], ids[i])), b.append(np.minimum(ids[linked], ids[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    # dealt by block, not by bucket: a large bucket's blocks go to many tasks
    schema = "bucket long, kind int, x int, y int, id long, component long, own int, outside boolean, bits array<long>"
    near = written(dealt.repartition(*place).groupBy(*place).applyInArrow(candidates, schema), "near")
    full = near.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    links = written(full.repartition(*place).groupBy(*place).applyInArrow(compare, "a long, b long").distinct(), "confirmed")
    discard(sizes, near)
    return links


def _judged(docs: DataFrame, k: int, percent: int, link_null_ids: bool) -> DataFrame:
    """_k1, _k2 (the row's name), doc_id, n_shingles, component_id, copies, leads: a row for each name, with its number of rows
    and whether it is the one of its class that is kept."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = source.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    signed = written(signatures(source, k).withColumn("id", F.xxhash64("s1", "s2")), "signatures")
    least = percent / 100 - MARGIN
    linkable = F.col("n_shingles") > 0
    if not link_null_ids:
        linkable = linkable & F.col("doc_id").isNotNull()
    names = written(signed.groupBy("_k1", "_k2", "doc_id", "n_shingles", "id").agg(F.count("*").alias("copies")), "names")
    node_rows = signed.where(linkable).select("id", "bands", "bits").dropDuplicates(["id"])
    banded = node_rows.select("id", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("bucket", "hub")
    # written first: AQE splits the hot keys of a join only between plain exchanges
    hubs = written(hubs, "hubs")
    members = written(banded.join(hubs, "bucket"), "members")

    # texts and signatures of sets that share a bucket, each with the text of one row
    sharing = members.select("id").distinct()
    spoken = names.where(linkable).groupBy("id").agg(F.min(F.struct("_k1", "_k2")).alias("m")).select("id", "m._k1", "m._k2").join(sharing, "id", "left_semi")
    spoken = written(spoken, "spoken")
    texts = compressed(source.select("_k1", "_k2", "text"), "text", "text").dropDuplicates(["_k1", "_k2"]).join(spoken, ["_k1", "_k2"])
    texts = written(texts.select(F.col("id").alias("doc_id"), "text"), "texts")
    bits = written(node_rows.select("id", "bits").join(sharing, "id", "left_semi"), "bits")
    discard(signed, hubs, spoken)
    near = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    near = near.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")), "b")
    near = written(near.select("a", "b", estimate(F.col("bits_a"), F.col("bits_b")).alias("similarity")).where(F.col("similarity") >= least), "near")

    best = near.groupBy("a").agg(F.max(F.struct("similarity", -F.col("b"))).alias("m")).select("a", (-F.col("m")["col2"]).alias("b"))
    first = written(_confirmed(best, texts, k, percent), "confirmed")
    # roots after a few steps along confirmed links; pairs with one root are joined already
    roots = first.where("linked").groupBy("a").agg(F.min("b").alias("root"))
    for _ in range(2):
        further = roots.select(F.col("a").alias("root"), F.col("root").alias("beyond"))
        roots = written(roots.join(further, "root", "left").select("a", F.coalesce("beyond", "root").alias("root")), "roots")
    one, two = (roots.select(F.col("a").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab")
    open_pairs = near.join(first.select("a", "b"), ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    second = written(_confirmed(open_pairs, texts, k, percent), "confirmed")
    checked = first.unionByName(second)
    discard(near, roots)

    found = components(checked.where("linked"))
    for_members = members.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "bucket", F.coalesce("component", "id").alias("component"))
    mixed = for_members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    mixed = written(mixed, "mixed")
    rest = written(for_members.join(mixed, "bucket", "left_semi"), "mixed")
    discard(mixed, members)
    late = _block_links(rest, bits, texts, least, k, percent)
    discard(rest, bits, texts)
    if not late.isEmpty():
        found = components(checked.where("linked").select("a", "b").unionByName(late))

    classed = names.where(linkable).join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("class", F.coalesce("component", "id"))
    classed = written(classed.drop("component"), "classes")
    discard(first, second, late, found)
    by_rank = F.struct(F.col("doc_id").isNull().alias("last"), "_k1", "_k2")
    leaders = written(classed.groupBy("class").agg(F.min(by_rank).alias("lead"), F.min("doc_id").alias("component_id")), "leaders")
    linked = classed.join(leaders, "class").withColumn("leads", by_rank == F.col("lead"))
    columns = ["_k1", "_k2", "doc_id", "n_shingles", "component_id", "copies", "leads"]
    alone = names.where(~linkable).withColumn("component_id", F.col("doc_id")).withColumn("leads", F.lit(True))
    return linked.select(columns).unionByName(alone.select(columns))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    judged = _judged(docs, k, percent, False)
    each = judged.select("doc_id", "n_shingles", "component_id", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return each.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = 75) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id, rows without one last; all columns stay.

    Of rows with equal doc_id and text, one stays: where other columns differ, that with the smallest hash of them all.
    """
    judged = written(_judged(docs, k, percent, True).select("_k1", "_k2", "copies", "leads"), "judged")
    gone = written(judged.where("not leads or copies > 1").select("_k1", "_k2"), "gone")
    repeated = written(judged.where("leads and copies > 1").select("_k1", "_k2"), "repeated")
    # one column holds the row, so no name can clash
    keyed = docs.select(F.struct("*").alias("row"), *row_key(F.col("doc_id"), F.col("text")))
    single = keyed.join(gone, ["_k1", "_k2"], "left_anti").select("row")
    again = keyed.join(repeated, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return single.unionByName(again.select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
