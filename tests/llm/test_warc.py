from __future__ import annotations

import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import warc
from sentrylake.llm.queries import ORACLES, QUERIES

PAGES = "page_id bigint, url string, html string"
LONG = "<p>" + "x" * 200 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumns({"of": F.lit("own"), "first_id": F.lit(1), "at": F.lit("z"), "n": F.lit(0)})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op3_warc']})").fetchall())
    got = QUERIES["op3_warc"](spark, f"/root/testdata/{sf}").select(*names).collect()
    assert sorted(tuple(r) for r in got) == want


def test_round_trip(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 7\r\n\r\n\r\n" + "é" * 60
    rows = [
        (2**60 + 7, "https://www.b.example/x?q=1#frag", LONG), (5, "http://a.example/", LONG), (9, "http://a.example/\r\nX: 1", LONG),
        (4, None, tricky), (3, "http://a.example/", tricky), (1, "http://a.example/", None), (2, "http://a.example/", ""),
        (6, "u", "short"), (7, "u", "short"), (None, "http://n.example/", LONG), (5, "http://a.example/", LONG),
    ]
    path = str(tmp_path / "arc")
    got = warc.archive(pages(spark, rows), path).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    want = sorted(
        (i is not None, i or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(),
         *(("revisit", f) if f is not None and i != f else ("response", None)))
        for i, _, h in rows for f in [{LONG: 5, tricky: 3}.get(h)]
    )
    assert sorted(((r.page_id is not None, r.page_id or 0, *r[1:5]) for r in got), key=str) == sorted(want, key=str)
    order = [(r.url_key, r["at"], r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    files = {f.name: gzip.decompress(f.read_bytes()) for f in Path(path).glob("*.gz")}
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:  # each entry leads to its record
        (head, at, length, block), *_ = warc.parse(files[r.file][r.offset : r.offset + r.length] + b"\r\n\r\n")
        assert at == 0 and length == r.length and head["warc-type"] == r.record_type
        if r.record_type == "response" and r.page_id is not None:
            assert block.partition(b"\r\n\r\n")[2] == html[r.page_id]
    assert sum(1 for f in files.values() for _ in warc.parse(f)) == len(rows)


def test_small_ranges_and_files(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(4)}.example/{rng.randrange(3)}", LONG + str(rng.randrange(30))) for i in range(400)]
    rows += [(i, "http://hot.example/", "same") for i in range(400, 600)]
    path = str(tmp_path / "arc")
    warc.write(pages(spark, rows), path, records_per_file=23)
    entries = warc.stored(warc.runs(spark, path))
    got = warc.merged_index(entries, range_rows=37).orderBy("position").collect()
    order = [(r.url_key, r["at"], r.page_id) for r in got]
    assert order == sorted(order) and len(got) == 600 and [r.position for r in got] == list(range(600))
    hot = {r.range_id for r in got if "hot" in r.url_key}
    assert len(hot) > 3  # one URL over several ranges


def test_loser_tree():
    rng = random.Random(9)
    for k in range(0, 12):
        sources = [sorted(rng.randrange(20) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(sources, lambda x: x)) == sorted(x for s in sources for x in s)


def test_empty_and_url_keys(spark, tmp_path):
    assert warc.archive(pages(spark, []), str(tmp_path / "none")).count() == 0
    assert warc.url_key("HTTP://User@WWW.Site.Example:80/P?q#f") == "example,site)/P?q"
    assert warc.url_key(None) == ")" and warc.url_key("site") == "site)"


def test_damaged_archives_are_reported():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_equal_records_over_several_ranges(spark, tmp_path):
    rows = [(7, "http://hot.example/", LONG)] * 120 + [(None, "http://none.example/", LONG)] * 120
    path = str(tmp_path / "arc")
    warc.write(pages(spark, rows), path, records_per_file=23)
    got = warc.merged_index(warc.stored(warc.runs(spark, path)), range_rows=30).orderBy("position").collect()
    order = [(r.url_key, r["at"], r.page_id is not None, r.page_id or 0, r.file, r.offset) for r in got]
    assert order == sorted(order) and len(got) == 240
    assert max(sum(r.range_id == k for r in got) for k in {r.range_id for r in got}) <= 60
