"""WARC capture archives, their index, and globally ordered capture histories by an external merge.

Each page becomes a response record, or a revisit of the record with the same payload and the largest page_id. Tasks write archives of
one gzip member a record, so a record can be read alone at its offset; a file is closed beyond ``ARCHIVE_BYTES``. Archives are read
back member by member, and each gives a run: its index rows, sorted by URL key and time, in a Parquet file with small row groups.

Runs are merged by a loser tree over k open files, a row group of each in memory. While there are more than ``FAN_IN``, groups of them
are merged into longer runs; then the key space is cut at sampled keys, and a task for each range merges its part of all runs. Row groups
outside a range are skipped by their statistics. So no run, range or URL has to fit in memory, and a much-captured URL may span ranges.

Archives and runs go to the shared folder through pyarrow.fs, under names of their own for each task attempt; only what a
finished task reports is read later, so a lost executor leaves nothing half-written in the result.

Defined cases: null html is an empty payload; a null url is an empty URL; a null page_id is a page of its own, which revisits the page with
its payload that has the largest page_id, and is a response where no page with that payload has an id; of rows that repeat the
largest page_id all are responses; an empty table writes and returns nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import release, shared_folder, written

#: Fixed strings of the format (ISO 28500).
CLOSE = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Alphabets of base 32 digits (RFC 4648, sections 7 and 6).
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
GZIP_LEVEL = 4
#: Rows in a row group of a run; runs that are merged at once; rows in a range of the last merge, on average, and the most ranges.
GROUP_ROWS, FAN_IN, RANGE_ROWS, MOST_RANGES = 2048, 64, 100_000, 4096
#: Captures have no time of their own here: page n is taken n seconds (modulo ``SPAN``) after this.
FIRST_CAPTURE, SPAN = datetime(2024, 1, 1, tzinfo=UTC), 300_000_000

INDEX = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64()), ("record_length", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])
INDEX_SQL = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in INDEX)
RUNS = "run string, rows long, firsts array<string>"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, in built-in functions: five hex digits are four base 32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, digest, size, target (the page that a revisit refers to, else null), html.

    Which page a payload's copies refer to is a partial aggregate over digests, and pages join it by digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    page = page.withColumns({"digest": base32_sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html").cast("long")})
    first = page.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("copies")).where("copies > 1")
    joined = page.join(first, "digest", "left")
    revisit = (F.col("size") >= least_bytes) & ~F.col("target").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "digest", "size", F.when(revisit, F.col("target")).alias("target"), "html")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _named(number: int | None) -> str:
    return "none" if number is None else str(number)


def record(page: int | None, url: str, digest: str, size: int, target: int | None, html: str, name: str) -> bytes:
    """A WARC record; ``name`` makes the id of a revisit its own."""
    revisit = target is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{_named(page)}:{name if revisit else digest}>",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url),
        f"WARC-Date: {FIRST_CAPTURE + timedelta(seconds=(page or 0) % SPAN):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {_named(page)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{target}:{digest}>", f"X-Payload-Length: {size}"]
    block = b"" if revisit else html.encode()
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + CLOSE + block + CLOSE


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives below ``path``; archive and records of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        prefix = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        out, name, records, done = None, "", 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    name, records = f"{prefix}-{len(done):05d}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                packer = zlib.compressobj(GZIP_LEVEL, wbits=31)
                out.write(packer.compress(record(*[c[i].as_py() for c in batch.columns], name=f"{name}:{records}")) + packer.flush())
                records += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        release()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done]), pa.array([r for _, r in done])], names=["archive", "records"])

    return written(captures(pages, least_bytes).mapInArrow(work, "archive string, records long"), "archives")


def url_key(url: str) -> str:
    """The host's labels from the top level down, then the rest, as capture indexes sort them."""
    host, _, rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")/" + rest.partition("#")[0]


def members(stream, size: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member of a file."""
    offset, raw = 0, b""
    while True:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not raw and not (raw := stream.read(size)):
                if used:
                    raise ValueError(f"the member at {offset} is cut off")
                return
            parts.append(unpack.decompress(raw))
            used += len(raw) - len(unpack.unused_data)
            raw = unpack.unused_data
        yield offset, used, b"".join(parts)
        offset += used


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    stop = raw.index(CLOSE)
    headers = dict(x.split(": ", 1) for x in raw[:stop].decode("utf-8").split("\r\n")[1:])
    size = int(headers["Content-Length"])
    return headers, raw[stop + 4 : stop + 4 + size]


def index_row(archive: str, offset: int, length: int, raw: bytes) -> tuple:
    """The index row of a record; a response's digest and size are those of the bytes read."""
    head, block = parsed(raw)
    kind, page = head["WARC-Type"], head["X-Page-ID"]
    claimed = head["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode() if kind == "response" else claimed
    if digest != claimed:
        raise ValueError(f"{archive}: the record at {offset} doesn't hold what was written")
    refers = int(head["WARC-Refers-To"].split(":")[2]) if kind == "revisit" else None
    size = len(block) if kind == "response" else int(head["X-Payload-Length"])
    return url_key(head["WARC-Target-URI"]), head["WARC-Date"], None if page == "none" else int(page), archive, offset, length, kind, refers, digest, size


def key_of(row: tuple) -> tuple:
    """The order of histories: URL key, time, page (none first), then the record's place, so that no two are equal."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


class RunWriter:
    """Writes rows in order as a run, and notes the first key of each row group."""

    def __init__(self, store, path: str):
        self.rows, self.count, self.firsts = [], 0, []
        self.out = pq.ParquetWriter(path, INDEX, filesystem=store, compression="zstd")

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= GROUP_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.firsts.append(packed_key(key_of(self.rows[0])))
            self.count += len(self.rows)
            self.out.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), INDEX, strict=True)], schema=INDEX), row_group_size=GROUP_ROWS)
            self.rows = []

    def close(self) -> tuple[int, list[str]]:
        self.flush()
        self.out.close()
        return self.count, self.firsts


def packed_key(key: tuple) -> str:
    import json

    return json.dumps(key)


def opened_key(text: str) -> tuple:
    import json

    return tuple(json.loads(text))


def read_run(store, path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple[tuple, tuple]]:
    """(key, row) of a run's rows with low <= key < high, a row group at a time."""
    with pq.ParquetFile(path, filesystem=store) as file:
        for g in range(file.metadata.num_row_groups):
            seen = file.metadata.row_group(g).column(0).statistics
            if seen is not None and seen.has_min_max and (low and seen.max < low[0] or high and seen.min > high[0]):
                continue
            columns = file.read_row_group(g).to_pydict()
            for row in zip(*columns.values(), strict=True):
                key = key_of(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, row


class LoserTree:
    """Merges k sorted iterators: inner nodes keep the losers, so each step replays one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) <= (y[0], b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.heads[best := self.losers[0]]) is not None:
            yield row
            self.heads[best] = next(self.runs[best], None)
            self._replay(best)


def index_archives(archives: DataFrame, path: str) -> DataFrame:
    """Read each archive back and write its sorted run; run, rows and the first key of each row group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = _store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    rows = [index_row(name, *found) for found in members(stream)]
                rows.sort(key=key_of)
                run = RunWriter(store, f"{folder}/{name}-{context.taskAttemptId()}.run")
                for row in rows:
                    run.add(row)
                count, firsts = run.close()
                yield _run_row(f"{name}-{context.taskAttemptId()}.run", count, firsts)
        release()

    return written(archives.select("archive").repartition(max(1, min(archives.count(), 20_000))).mapInArrow(work, RUNS), "runs")


def _run_row(run: str, count: int, firsts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([run]), pa.array([count]), pa.array([firsts], pa.list_(pa.string()))], names=["run", "rows", "firsts"])


def longer_runs(runs: DataFrame, path: str, groups: int) -> DataFrame:
    """One pass of the merge: groups of runs become a run each."""

    def work(table: pa.Table) -> pa.Table:
        store, folder = _store(path)
        names = sorted(table.column("run").to_pylist())
        name = f"merged-{hashlib.sha1(names[0].encode()).hexdigest()[:16]}-{TaskContext.get().taskAttemptId()}.run"
        out = RunWriter(store, f"{folder}/{name}")
        for _, row in LoserTree([read_run(store, f"{folder}/{run}") for run in names]):
            out.add(row)
        release()
        return pa.Table.from_batches([_run_row(name, *out.close())])

    return written(runs.repartition(groups, "run").groupBy(F.pmod(F.xxhash64("run"), F.lit(groups))).applyInArrow(work, RUNS), "runs")


def merge_runs(runs: DataFrame, path: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in global order: partition i holds what comes before partition i + 1."""
    spark = runs.sparkSession
    while (k := runs.count()) > fan_in:
        runs = longer_runs(runs, path, -(-2 * k // fan_in))
    names = sorted(r[0] for r in runs.select("run").collect())  # fan_in at most
    keys = runs.select(F.explode("firsts").alias("key"))
    total, groups = runs.agg(F.sum("rows"), F.sum(F.size("firsts"))).first()
    ranges = max(1, min(-(-(total or 0) // range_rows), MOST_RANGES))
    # about twenty keys a range say where to cut; where the cuts fall decides balance, never the result
    sample = keys.where(F.pmod(F.xxhash64("key"), F.lit(max(1, (groups or 0) // (20 * ranges)))) == 0) if ranges > 1 else keys.limit(0)
    known = sorted({opened_key(r[0]) for r in sample.collect()})
    cuts = sorted({known[len(known) * i // ranges] for i in range(1, ranges)}) if known else []
    held = spark.sparkContext.broadcast((names, [None, *cuts, None]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bounds = held.value
        store, folder = _store(path)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = []
                for _, row in LoserTree([read_run(store, f"{folder}/{name}", bounds[i], bounds[i + 1]) for name in names]):
                    rows.append(row)
                    if len(rows) == GROUP_ROWS:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
        release()

    return spark.range(0, len(cuts) + 1, 1, len(cuts) + 1).mapInArrow(work, INDEX_SQL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), INDEX, strict=True)], schema=INDEX)


def read_record(path: str, archive: str, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, read at its place alone."""
    store, folder = _store(path)
    with store.open_input_file(f"{folder}/{archive}") as file:
        file.seek(offset)
        return parsed(next(members(file))[2])


def capture_histories(pages: DataFrame, least_bytes: int = 0, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **merge) -> DataFrame:
    """Write the archives, read them back and merge their runs."""
    spark: SparkSession = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    runs = index_archives(write_archives(pages, path, least_bytes, archive_bytes), path)
    return merge_runs(runs, path, **merge)


def archive_digest(pages: DataFrame, **options) -> DataFrame:
    """The columns of the query."""
    return capture_histories(pages, **options).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
