"""Archives, revisits and merged histories."""

from __future__ import annotations

import hashlib
import random

from gramwise.llm import warc
from gramwise.llm.common import shared_folder, written


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as digest", "1 as size", "'y' as latest", "'z' as payload")


def _rows():
    rng = random.Random(1)
    big = ["é" * 600, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 40, "x" * 999 + "\r\n\r\n", "y" * 999]
    rows = [(i, f"http://H{i % 3}.example.org/{i % 7}#f", rng.choice([*big, f"page {i}", "", None])) for i in range(120)]
    return rows + [(5, rows[5][1], rows[5][2]), (None, None, big[0]), (500, "no url", big[0]), (501, "http://a/\r\nX: 1", "z" * 2000), (None, "http://n/", "q" * 1500), (None, "http://n/", "q" * 1500)]


def _expected(rows):
    latest = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and page is not None:
            latest[payload] = max(page, latest.get(payload, page))
    for page, _, html in rows:
        payload = (html or "").encode()
        target = latest.get(payload)
        revisit = target is not None and page != target
        yield str(page), len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", target if revisit else None


def test_round_trip_and_revisits(spark):
    rows, path = _rows(), shared_folder(spark, "archives")
    warc.write_archives(_pages(spark, rows), path)
    runs = written(warc.read_runs(spark, path), "runs")
    for per_range in (10, 50_000):
        merged = warc.merged_histories(runs, per_range).orderBy("history_range", "position").collect()
        found = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in merged)
        assert sorted(found, key=str) == sorted(_expected(rows), key=str)
        keys = [warc._order((r["url_key"], r["captured_at"], r["page_id"])) for r in merged]
        assert keys == sorted(keys)
        placed = warc.in_global_order(written(warc.merged_histories(runs, per_range), "histories")).orderBy("position").collect()
        assert [r["position"] for r in placed] == list(range(len(rows)))
        assert [warc._order((r["url_key"], r["captured_at"], r["page_id"])) for r in placed] == keys
        assert all(r["stored_bytes"] == (0 if r["record_type"] == "revisit" else r["payload_bytes"]) for r in merged)


def test_empty_table(spark):
    path = shared_folder(spark, "archives")
    warc.write_archives(_pages(spark, []), path)
    assert warc.merged_histories(written(warc.read_runs(spark, path), "runs")).collect() == []


def test_url_keys():
    assert warc.url_key("https://WWW.Example.org:80/a?b#c") == "org:80,example,www)/a?b"
    assert warc.url_key("no url") == "no url" and warc.url_key(None) is None


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    for k in range(12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.choice((0, 1, 7, 30)))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)
    # Equal heads come in the order of the runs.
    assert list(warc.LoserTree([[(1, "a")], [(1, "b")], [(0, "c")]], lambda x: x[0])) == [(0, "c"), (1, "a"), (1, "b")]
