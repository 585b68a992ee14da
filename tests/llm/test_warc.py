"""Archives: round trip, revisits, loser tree and global order."""

import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest

from mathgrade.llm import warc

BIG = "<p>" + "größer " * 300 + "\r\n\r\nWARC/1.0\r\n" + "</p>"
ROWS = [(1, "http://www.b.org/x?b=2&a=1#top", BIG), (2, "https://a.org/", BIG), (3, None, "small"), (4, "http://a.org/ b\r\n", "small"), (5, "http://a.org/", None),
        (None, "http://c.org", BIG), (6, "http://b.org/x?a=1&b=2", ""), (2, "https://a.org/", BIG), (7, "http://d.org:8080/y", BIG + "!"), (7, "http://d.org:8080/y", BIG + "!")]


def expected(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        latest = max(same) if same and len(raw) >= 1000 else page
        revisit = len(raw) >= 1000 and latest != page and bool(same)
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", latest if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_rows", [2, 50_000])
def test_round_trip(spark, tmp_path, range_rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, date string, payload_bytes int")
    warc.write(df, str(tmp_path / "w"), records_per_file=3)
    got = warc.index(spark, str(tmp_path / "w"), range_rows).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(ROWS)
    got = sorted(got, key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(ROWS)))
    keys = [(r.url_key, r.date) for r in got]
    assert keys == sorted(keys)
    read = []
    for f in Path(tmp_path / "w").glob("part-*"):
        with gzip.open(f) as stream:
            read += list(warc.records(stream))
    assert len(read) == len(ROWS)
    assert sorted(b.partition(b"\r\n\r\n")[2].decode() for h, b in read if h["warc-type"] == "response") == sorted(
        (h or "") for (p, _, h), e in ((r, [x for x in expected(ROWS) if x[0] == r[0] and x[1] == len((r[2] or "").encode())][0]) for r in ROWS) if e[3] == "response")


def test_a_third_of_all_pages_are_equal(spark, tmp_path):
    rows = [(i, f"http://h.org/{i % 7}", BIG if i % 3 == 0 else f"page {i} " * 200) for i in range(120)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_truncated_archives_are_refused():
    whole = b"WARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert [b for _, b in warc.records(io.BytesIO(whole))] == [b"abcde"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(whole[:-6])))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
    tree = warc.LoserTree(runs)
    assert [tree.sequences[i][j] for i, j in tree] == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=2&a=1#f") == "com,example)/A?a=1&b=2"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key("http://[bad") == "http://[bad"
