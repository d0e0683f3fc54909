"""WARC files and a two-level capture index.

``write_warcs`` turns pages into WARC 1.0 response records, each its own gzip member, in one file per task.
``build_index`` sorts the captures by reversed-host URL key (``com,example,www)/path?query``) over range
partitions and packs ``block_lines`` index lines at a time into compressed blocks (level one); the
directory keeps only the first key, file, offset and length of each block (level two). ``lookup`` binary-searches
the directory for each key, reads a block once for all its keys by one range read, binary-searches its lines,
and fetches each record by another range read.

Files go to the folder of ``spark.checkpoint.dir`` through pyarrow's file systems. Every attempt of a task writes
files of its own, and the index names only those of the attempt that was committed, so retries and lost
executors leave nothing wrong behind. A directory of up to ``BROADCAST_ROWS`` blocks (3 billion captures)
is broadcast; beyond it, every 1,024th key is, and the rest is joined by that coarse number.

Defined results: pages with a null url have no key and are left out; a null html is an empty body; a url without a
scheme gets an empty host; repeated urls and repeated rows are captures of their own, all of which a look-up
returns, in the order of page_id, null first; a key that was never captured returns nothing; line breaks in a url are escaped; whole bodies are stored;
an empty table gives an empty index; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import BROADCAST_ROWS, fresh_path, shared_dir, written

BLOCK_LINES = 3000
COARSE = 1024
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*"


def surt(url: Column) -> Column:
    """Reversed-host key of a URL: scheme, user, port and fragment go, the host is lower-cased."""
    rest = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.regexp_extract(rest, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""))
    path = F.regexp_replace(rest, _SCHEME, "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    for raw, code in ((" ", "%20"), ("\n", "%0A"), ("\r", "%0D")):  # a key is one word of one line
        key = F.replace(key, F.lit(raw), F.lit(code))
    return key


def record(url: str, html: bytes) -> bytes:
    url = url.replace("\r", "%0D").replace("\n", "%0A")  # a header is one line
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html
    ident = uuid.UUID(bytes=hashlib.md5(url.encode() + html).digest())
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{ident}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def html_of(member: bytes) -> bytes:
    """The page of a compressed record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length:")[2])
    return rest[:size].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warcs(pages: DataFrame, folder: str) -> DataFrame:
    """One line for each capture: page_id, url, key, file, at, size, digest. Read it once, or write it down."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        name, out, at = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            files, ats, sizes, digests = [], [], [], []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                body = (html or "").encode()
                data = _gzip(record(url, body))
                out.write(data)
                files.append(name)
                ats.append(at)
                sizes.append(len(data))
                digests.append(hashlib.sha1(body).hexdigest())
                at += len(data)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("key"), pa.array(files, pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["page_id", "key", "file", "at", "size", "digest"])
        if out is not None:
            out.close()

    rows = pages.where("url IS NOT NULL").select(F.col("page_id").cast("long"), "url", "html", surt(F.col("url")).alias("key"))
    return rows.mapInArrow(run, "page_id long, key string, file string, at long, size long, digest string")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The directory: first (key of the block), file, at, size, lines."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        name, out, at = f"{base}/{uuid.uuid4().hex}.idx", None, 0
        lines: list[tuple[str, str]] = []

        def flush(part):
            nonlocal out, at
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(name, compression=None)
            data = zlib.compress("\n".join(f"{k} {v}" for k, v in part).encode(), 6)
            out.write(data)
            row = (part[0][0], name, at, len(data), len(part))
            at += len(data)
            return row

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()))], names=["first", "file", "at", "size", "lines"])

        for b in batches:
            rows = []
            for r in b.to_pylist():
                lines.append((r["key"], json.dumps([r["page_id"], r["file"], r["at"], r["size"], r["digest"]])))
                if len(lines) == block_lines:
                    rows.append(flush(lines))
                    lines = []
            yield table(rows)
        if lines:
            yield table([flush(lines)])
        if out is not None:
            out.close()

    return captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "at").mapInArrow(run, "first string, file string, at long, size long, lines int")


def lookup(keys: DataFrame, directory: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(key, page_id, html) of every capture of each distinct key in ``keys`` (one column, key)."""
    plain = keys.where("key IS NOT NULL").select("key").distinct()
    schema = "key string, file string, at long, size long"
    n = directory.count()
    if not n:
        return plain.where("false").mapInArrow(lambda it: it, "key string").select("key", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("binary").alias("html"))
    if n <= limit:
        top = directory.toArrow()
        firsts = sorted(k.encode() for k in top.column("first").to_pylist())
        order = sorted(range(n), key=lambda i: (top.column("first")[i].as_py().encode(), top.column("file")[i].as_py(), top.column("at")[i].as_py()))
        files, ats, sizes = (top.column(c).take(pa.array(order)).combine_chunks() for c in ("file", "at", "size"))

        def place(batches):
            for b in batches:
                out: list[list] = [[], []]
                for key in b.column("key").to_pylist():
                    q = key.encode()
                    for k in range(max(0, bisect_left(firsts, q) - 1), bisect_right(firsts, q)):
                        for col, x in zip(out, (key, k)):
                            col.append(x)
                k = pa.array(out[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), files.take(k), ats.take(k), sizes.take(k)], names=["key", "file", "at", "size"])

        placed = plain.mapInArrow(place, schema)
    else:
        placed = _coarse(plain, directory, n, schema)

    def fetch(batches):
        opened: dict = {}
        held, lines, names = None, [], []

        def read(name, at, size):
            if name not in opened:
                if len(opened) > 64:
                    for f in opened.values():
                        f.close()
                    opened.clear()
                opened[name] = fs.open_input_file(name)
            return opened[name].read_at(size, at)

        fs = pafs.FileSystem.from_uri(folder_of)[0]
        for b in batches:
            out: list[list] = [[], [], []]
            for r in b.to_pylist():
                if held != (r["file"], r["at"]):
                    held = (r["file"], r["at"])
                    lines = zlib.decompress(read(r["file"], r["at"], r["size"])).decode().split("\n")
                    names = [x.partition(" ")[0].encode() for x in lines]
                q = r["key"].encode()
                for k in range(bisect_left(names, q), bisect_right(names, q)):
                    page, file, at, size, digest = json.loads(lines[k].partition(" ")[2])
                    html = html_of(read(file, at, size))
                    if hashlib.sha1(html).hexdigest() != digest:
                        raise OSError(f"{file} at {at}: the record isn't the one that was indexed")
                    for col, x in zip(out, (r["key"], page, html)):
                        col.append(x)
                    if sum(map(len, out[2][-256:])) > 32 << 20:
                        yield _rows(out)
                        out = [[], [], []]
            yield _rows(out)
        for f in opened.values():
            f.close()

    folder_of = shared_dir(directory.sparkSession)
    # The pointers are few bytes, the records behind them many: the number of tasks follows that of the blocks.
    tasks = min(n, max(directory.sparkSession.sparkContext.defaultParallelism, n // 8))
    return placed.repartition(tasks, "file", "at").sortWithinPartitions("file", "at", "key").mapInArrow(fetch, "key string, page_id long, html binary")


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["key", "page_id", "html"])


def _coarse(keys: DataFrame, directory: DataFrame, n: int, schema: str) -> DataFrame:
    """Blocks of each key by a join on ranges of about ``COARSE`` directory lines."""
    share = max(2, n // COARSE)
    cuts = [r[0] for r in directory.select(F.encode("first", "UTF-8").alias("first")).sample(min(1.0, 8.0 * share / n), 1).selectExpr("first").distinct().orderBy("first").collect()][::8]
    cuts = [bytes(c) for c in cuts]

    def ranges(batches):
        for b in batches:
            q = [k.encode() for k in b.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([bisect_right(cuts, x) for x in q], pa.int64())], names=["key", "r"])

    def blocks(batches):
        for b in batches:
            yield b.append_column("r", pa.array([bisect_right(cuts, x.encode()) for x in b.column("first").to_pylist()], pa.int64()))

    own = directory.select("first", "file", "at", "size").mapInArrow(blocks, "first string, file string, at long, size long, r long")
    parts = own.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("first", "file", "at", "size"))).alias("d"))
    # A key may begin in the last block of a range before its own, or spread over whole ranges of one key.
    last = parts.select("r", F.element_at("d", -1).alias("e")).orderBy("r").collect()
    before = {}
    prev = None
    for row in last:
        before[row["r"]] = prev
        prev = row["e"]
    held = [(r, tuple(e) if e else None) for r, e in before.items()]
    held.sort()
    rs = [r for r, _ in held]

    def pick(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for row in b.to_pylist():
                d = [tuple(x.values()) for x in (row["d"] or [])]
                i = bisect_right(rs, row["r"]) - 1
                extra = held[i][1] if i >= 0 and rs[i] == row["r"] else (None if i < 0 else tuple(last[i]["e"]))
                if extra:
                    d.insert(0, extra)
                firsts, q = [x[0].encode() for x in d], row["key"].encode()
                for k in range(max(0, bisect_left(firsts, q) - 1), bisect_right(firsts, q)):
                    for col, x in zip(out, (row["key"], *d[k][1:])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "at", "size"])

    return keys.mapInArrow(ranges, "key string, r long").join(parts, "r", "left").mapInArrow(pick, schema)


def captures(pages: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(surt, page_id, html_md5, html_bytes): every page, written to WARC, indexed, and read back through the index by its key."""
    spark = pages.sparkSession
    listed = written(write_warcs(pages, fresh_path(spark, "warc")), "warc-captures")
    directory = written(build_index(listed, fresh_path(spark, "warc-index"), block_lines), "warc-directory")
    found = lookup(listed.select("key"), directory)
    return found.select(F.col("key").alias("surt"), "page_id", F.md5("html").alias("html_md5"), F.length("html").cast("long").alias("html_bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH r AS (SELECT page_id, html, regexp_replace(url, '#.*$', '') AS rest FROM pages WHERE url IS NOT NULL),
h AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(rest, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*', '') AS path,
    lower(regexp_replace(regexp_replace(regexp_extract(rest, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host
  FROM r)
SELECT replace(replace(replace(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END, ' ', '%20'), chr(10), '%0A'), chr(13), '%0D') AS surt,
  page_id, md5(html) AS html_md5, CAST(strlen(html) AS BIGINT) AS html_bytes
FROM h
"""
