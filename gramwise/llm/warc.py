"""WARC archives written and read by Spark, and their index merged into capture histories.

Archives are files of whole records in the shared folder; equal payloads are stored once, later ones as revisits.  Each
archive read back gives one run of captures, sorted by URL key, time and page.  Runs are cut at sampled keys into ranges, and a
loser tree merges all pieces of a range, so that the ranges one after another are the capture histories in global order.

Defined results: null html is an empty payload; a null URL has a null key and sorts first; rows with the same largest page id
and payload are all responses; a null page id never is the one referred to unless all are null, when all are responses;
other columns are ignored.  The table has no capture times: page ids stand for seconds after a fixed start.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramwise.llm.common import shared_folder, table

LEAST_SHARED = 1000
RECORDS_PER_ARCHIVE = 1000
CAPTURES_PER_RANGE = 50_000
BREAK = "\r\n"
#: Start of the capture times, 2024-01-01 UTC in seconds.
START = 1_704_067_200


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per row of ``pages(page_id, url, html)``; a file holds a bounded number of records."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    groups = rows.filter(F.col("size") >= LEAST_SHARED).groupBy("digest", "size").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(groups.filter("n > 1").drop("n"), ["digest", "size"], "left")
    revisit = F.col("latest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("latest")))
    date = F.date_format(F.timestamp_seconds(F.lit(START) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    identity = F.sha1(F.concat_ws(" ", F.col("page_id").cast("string"), "url", "digest").cast("binary"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("size"), F.lit(BREAK * 2))
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))).otherwise("")

    record = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:sha1:"), identity, F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-ID", F.when(revisit, F.col("latest").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(BREAK),
        body,
    )
    # Every record ends in two line breaks: the separator that the text writer puts after each row.
    lines = rows.select(record.alias("value"))
    lines.write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).option("compression", "gzip").text(path)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive, by the lengths that the headers give."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split(BREAK)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start, size = end + 4, int(headers["Content-Length"])
        block, at = archive[start : start + size], start + size + 4
        if len(block) != size or archive[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {start} is cut off")
        yield headers, block


_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)")


def url_key(url: str | None) -> str | None:
    """Host labels from the last to the first, then path and query; scheme and fragment do not count."""
    if url is None:
        return None
    found = _URL.match(url)
    return f"{','.join(reversed(found[1].lower().split('.')))}){found[2]}" if found else url


_CAPTURE = "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, stored_bytes bigint"
_STRUCT = ", ".join(":".join(x.split()) for x in _CAPTURE.split(", "))
_FIELDS = [x.split()[0] for x in _CAPTURE.split(", ")]


def _order(capture: Sequence) -> tuple:
    """Sort key of a capture: nulls first in each of URL key, time and page."""
    return tuple((x is not None, x if x is not None else "") if not isinstance(x, int) else (True, x) for x in capture[:2]) + (
        (capture[2] is not None, capture[2] if capture[2] is not None else 0),
    )


def read_runs(spark, path: str) -> DataFrame:
    """One row per archive: ``run, captures``, sorted."""
    import hashlib

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = []
                for headers, block in records(zlib.decompress(content.as_py(), 47)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b": ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind, page, target = headers["WARC-Type"], headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"page {page}: the payload read back differs")
                    found.append((url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], page and int(page), size, digest, kind, target and int(target), len(payload)))
                found.sort(key=_order)
                yield pa.RecordBatch.from_pylist([{"run": name, "captures": [dict(zip(_FIELDS, x, strict=True)) for x in found]}], schema=schema)

    fields = [(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in _CAPTURE.split(", "))]
    schema = pa.schema([("run", pa.string()), ("captures", pa.list_(pa.struct(fields)))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, f"run string, captures array<struct<{_STRUCT}>>")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner needs one path to the root."""

    def __init__(self, runs: Sequence[Sequence], order=lambda x: x):
        self._runs, self._order = runs, order
        self._next = [0] * len(runs)
        self._heads = [self._head(i) for i in range(len(runs))]
        self._losers = [-1] * max(len(runs), 1)
        self._winner = self._play(1) if len(runs) > 1 else 0

    def _head(self, run: int) -> tuple:
        """What a run plays with; an ended run loses to all, equal heads go by run."""
        at = self._next[run]
        return (0, self._order(self._runs[run][at]), run) if at < len(self._runs[run]) else (1, (), run)

    def _play(self, node: int) -> int:
        if node >= len(self._runs):
            return node - len(self._runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._heads[b] < self._heads[a]:
            a, b = b, a
        self._losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        k = len(self._runs)
        while k and self._heads[self._winner][0] == 0:
            run = self._winner
            yield self._runs[run][self._next[run]]
            self._next[run] += 1
            self._heads[run] = self._head(run)
            node = (run + k) // 2
            while node:
                if self._heads[self._losers[node]] < self._heads[run]:
                    run, self._losers[node] = self._losers[node], run
                node //= 2
            self._winner = run


def merged_histories(runs: DataFrame, per_range: int = CAPTURES_PER_RANGE, sample: int = 10_000, per_cut: int = 8) -> DataFrame:
    """All captures in global order: by ``history_range``, then ``position``.  ``runs`` is read three times: give a table.

    Ranges are cut at keys of URL, time and page drawn by hash from all captures, about ``sample`` of them and ``per_cut`` for each
    range at least, so that ranges stay as large as they are meant to be and a URL with very many captures is cut as well.
    """
    keys = runs.select(F.explode("captures").alias("x")).select("x.url_key", "x.captured_at", "x.page_id")
    total = keys.count()
    ranges = max(1, -(-total // per_range))
    draw = F.pmod(F.xxhash64("url_key", "captured_at", "page_id"), F.lit(1 << 40)) / float(1 << 40)
    share = max(sample, per_cut * ranges) / max(total, 1)
    drawn = sorted(_order(x) for x in keys.filter(draw < share).collect()) if ranges > 1 else []
    cuts = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []

    def cut(batches):
        for batch in batches:
            for run, captures in zip(batch.column("run").to_pylist(), batch.column("captures").to_pylist(), strict=True):
                places = [bisect.bisect_right(cuts, _order(list(x.values()))) for x in captures]
                edges = [bisect.bisect_left(places, r) for r in range(len(cuts) + 2)]
                rows = [{"history_range": r, "run": run, "captures": captures[a:b]} for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("history_range", pa.int32()), *batch.schema]))

    def merge(group: pa.Table) -> pa.Table:
        number = group.column("history_range")[0].as_py()
        rows = sorted(group.select(["run", "captures"]).to_pylist(), key=lambda x: x["run"])
        tree = LoserTree([x["captures"] for x in rows], lambda x: _order(list(x.values())))
        out = [{"history_range": number, "position": i, **x} for i, x in enumerate(tree)]
        fields = [("history_range", pa.int32()), ("position", pa.int64())]
        fields += [(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in _CAPTURE.split(", "))]
        return pa.Table.from_pylist(out, schema=pa.schema(fields))

    pieces = runs.mapInArrow(cut, "history_range int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema))
    return pieces.groupBy("history_range").applyInArrow(merge, f"history_range int, position bigint, {_CAPTURE}")


def in_global_order(histories: DataFrame) -> DataFrame:
    """``merged_histories`` with positions from 0 over all ranges.  Read twice: give a table."""
    before = Window.orderBy("history_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    counts = histories.groupBy("history_range").agg(F.count(F.lit(1)).alias("captures"))
    starts = counts.select("history_range", F.coalesce(F.sum("captures").over(before), F.lit(0)).alias("start"))
    return histories.join(starts, "history_range").withColumn("position", F.col("start") + F.col("position")).drop("start")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them in the order of the capture histories."""
    from gramwise.llm.common import written

    path = shared_folder(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    merged = in_global_order(written(merged_histories(written(read_runs(spark, path), "runs")), "histories"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


ORACLE = r"""
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
q as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as latest from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id < latest then 'revisit' else 'response' end as record_type,
  case when page_id < latest then latest end as refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.')), ',') || ')'
    || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) as url_key,
  row_number() over (order by url_key nulls first, coalesce(page_id, 0) % 1000000000, page_id nulls first) - 1 as position
from q
"""
