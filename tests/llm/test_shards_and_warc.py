import base64
import gzip
import hashlib
import random
import zlib

import pyarrow.fs
import pytest
from llm_helpers import docs_of

from cardlens.llm import shards, warc
from cardlens.llm._util import scratch_path

PAGES = "page_id long, url string, html string, size long, path string"


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(400)) for i in range(900)] + [(5, "same"), (5, "same"), (None, "no id"), (7, None), (8, "")]
    rows += [(3, "hot")] * 500
    rng.shuffle(rows)
    out = shards.byte_shards(docs_of(spark, rows, extra=True)).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in out))) == sorted(
        map(str, ((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)))
    total = sum(r.size for r in out)
    top = max(r.size for r in out)
    for k in range(24):
        mine = [r for r in out if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 24) <= top
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    keys = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in order]
    assert keys == sorted(keys)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}


def test_shards_of_few_huge_and_no_rows(spark):
    assert shards.byte_shards(docs_of(spark, [])).count() == 0
    out = {r.doc_id: r.shard for r in shards.byte_shards(docs_of(spark, [(1, "a"), (2, "b" * 10**6), (3, "c")])).collect()}
    assert out[1] == 0 and out[3] == 23 and 0 < out[2] < 23


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def pages_rows():
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}?é\n", "".join(rng.choice("abc<>é\r\n") for _ in range(rng.randrange(3000)))) for i in range(300)]
    rows += [(1000 + i, "http://copy", "one and the same") for i in range(200)]
    rows += [(2000, None, None), (2001, "u", ""), (2002, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "no id"), (2003, "n", "no id"),
             (None, "m", "alone"), (2004, "t", "twice"), (2004, "t", "twice"), (2005, "b", "x" * 3_000_000)]
    rows.append((2006, "z", gzip.compress(b"WARC/1.1\r\n").decode("latin-1")))
    return rows


def expected(rows, least=0):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        h = h or ""
        lead = None if top[h] == -1 else top[h]
        again = lead is not None and i != lead and len(h.encode()) >= least
        out.append((i, len(h.encode()), digest(h), "revisit" if again else "response", lead if again else None))
    return sorted(map(str, out))


def test_pages_come_back(spark):
    rows = pages_rows()
    rng = random.Random(3)
    rng.shuffle(rows)
    pages = spark.createDataFrame([(*r, 1, "p") for r in rows], PAGES)
    out = warc.archive_pages(pages).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out) == expected(rows)
    assert warc.archive_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize("step", [50, 1000, 10**7])
def test_any_ranges_read_each_record_once(spark, step):
    rows = pages_rows()[:40] + pages_rows()[-8:]
    pages = spark.createDataFrame([(*r, 1, "p") for r in rows], PAGES)
    archives = warc.write_warc(pages, scratch_path(spark, "warc-test"), revisit_bytes=5, archive_bytes=20_000)
    assert archives.count() > 1 and archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_warc(archives, range_bytes=step if step > 50 else 5000).collect()
    whole = {str((r.record_id, r.record_type, r.payload_digest, r.payload_bytes)) for r in got}
    assert len(got) == len(rows) and len(whole) <= len(rows)
    for r in got:
        assert r.record_type == "revisit" or digest(r.payload.decode()) == r.payload_digest


def archive(tmp_path, records):
    data = b"".join(records)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    return str(path), data


def starts(path, size, step):
    fs = pyarrow.fs.LocalFileSystem()
    out = []
    for a in range(0, size, step):
        with fs.open_input_file(path) as f:
            out.append(warc._records(f, a, a + step, size))
    return out


def test_members_inside_stored_members_are_not_records(tmp_path):
    """An archive stored uncompressed in a record of another looks like members."""
    inner = b"".join(warc._record(i, "u", b"inner %d" % i, None, False) for i in range(6))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inner)
    outer = stored.compress(head + inner + b"\r\n\r\n") + stored.flush()
    path, data = archive(tmp_path, [warc._record(1, "u", b"first", None, False), outer, warc._record(2, "u", b"last", None, False)])
    for step in (64, 200, 10**6):
        assert sum(map(len, starts(path, len(data), step))) == 3


def test_damage_is_an_error(tmp_path):
    good = [warc._record(i, "u", random.Random(i).randbytes(400), None, False) for i in range(5)]
    path, data = archive(tmp_path, [*good[:3], good[3][:-20]])
    with pytest.raises(ValueError):
        starts(path, len(data), 10**6)
    record = gzip.decompress(good[0]).replace(b"Content-Type: text/html", b"Content-Type: text/htmX")
    assert warc._parse(record)["payload_bytes"] == 400
    with pytest.raises(ValueError):
        warc._parse(record[:-10] + b"XX" + record[-8:])
