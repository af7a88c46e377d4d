import hashlib
import io
import zlib

import pytest

from trawl.llm import warc

DATE = "2000-01-01T00:00:00Z"


def made(n, body=lambda k: b"payload %d " % k * 30):
    return [warc.record("response", k, f"http://x/{k}", body(k), hashlib.sha256(body(k)).hexdigest(), None, DATE) for k in range(n)]


def salvaged(data, zipped):
    class Source(io.BytesIO):
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return data[at : at + n]

    found = list(warc.salvage(Source(data), zipped))
    ids = [int(x[2]["warc-record-id"][10:-1]) for x in found if x[0] == "record"]
    return ids, [x[1:] for x in found if x[0] == "gap"]


@pytest.mark.parametrize("zipped", [True, False])
def test_undamaged_and_empty(zipped):
    parts = [zlib.compress(x, 5, 31) if zipped else x for x in made(6)]
    assert salvaged(b"".join(parts), zipped) == (list(range(6)), [])
    assert salvaged(b"", zipped) == ([], [])


@pytest.mark.parametrize("chunk", [7, 100, 1 << 20])
def test_plain_damage_is_logged_and_later_records_come_back(chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    parts = made(6)
    for bad in range(6):
        at = sum(map(len, parts[:bad]))
        for hit in (2, len(parts[bad]) - 50, len(parts[bad]) - 2):
            data = bytearray(b"".join(parts))
            data[at + hit] ^= 0x15
            ids, gaps = salvaged(bytes(data), False)
            assert ids == [k for k in range(6) if k != bad], (bad, hit)
            assert [g[:2] for g in gaps] == [(at, at + len(parts[bad]))], (bad, hit, gaps)
    data = b"".join(parts)
    ids, gaps = salvaged(data[:-10], False)
    assert ids == [0, 1, 2, 3, 4] and gaps[0][:2] == (len(data) - len(parts[5]), len(data) - 10)
    ids, gaps = salvaged(b"junk\r\n" * 40 + data, False)
    assert ids == list(range(6)) and gaps[0][:2] == (0, 240)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_zipped_damage(chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    parts = [zlib.compress(x, 5, 31) for x in made(5)]
    for bad in range(5):
        at = sum(map(len, parts[:bad]))
        for hit in (0, 3, 15, len(parts[bad]) // 2, len(parts[bad]) - 6):
            data = bytearray(b"".join(parts))
            data[at + hit] ^= 0xFF
            ids, gaps = salvaged(bytes(data), True)
            if hit == 3:
                assert set(ids) >= {k for k in range(5) if k != bad}
                continue
            assert ids == [k for k in range(5) if k != bad], (bad, hit)
            assert [g[:2] for g in gaps] == [(at, at + len(parts[bad]))], (bad, hit)
    data = b"".join(parts)
    assert salvaged(data[: -len(parts[4]) // 2], True)[0] == [0, 1, 2, 3]
    # one member with several records, the last cut off
    whole = zlib.compress(b"".join(made(3)), 5, 31)
    assert salvaged(whole, True)[0] == [0, 1, 2]


def test_round_trip_with_nulls_repeats_and_odd_payloads(spark):
    rows = [
        (5, "http://a", "x" * 200), (3, "http://b\r\nWARC/1.1", "x" * 200), (9, None, "x" * 200), (7, "u", "short"), (8, "u", "short"),
        (1, "u", None), (2, "u", ""), (None, "u", "x" * 200), (4, "u", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9),
        (3, "u", "x" * 200), (10, "u", "q" * 3_000_000), (11, "http://" + "long/" * 14_000, "y" * 150),
    ]
    pages = spark.createDataFrame([(a, b, c, "other", 1) for a, b, c in rows], "page_id long, url string, html string, digest string, refers_to int").repartition(3)
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()))
    want = []
    for page_id, _, text in rows:
        data = (text or "").encode()
        again = text == "x" * 200 and page_id != 3
        want.append((page_id is None, page_id or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_gaps_are_rows_and_payloads_are_kept(spark, tmp_path):
    parts = made(4)
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + 30] ^= 1
    (tmp_path / "a.warc").write_bytes(bytes(data))
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "file string")).collect()
    assert [(r.type, r.at) for r in got] == [("response", 0), ("gap", len(parts[0])), ("response", len(parts[0]) + len(parts[1])), ("response", sum(map(len, parts[:3])))]
    assert got[1].gap_to == len(parts[0]) + len(parts[1]) and "digest" in got[1].reason or "header" in got[1].reason
    assert bytes(got[0].payload) == b"payload 0 " * 30
    assert warc.read_archives(spark.createDataFrame([], "file string")).count() == 0



@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_long_headers_and_stated_lengths(chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    parts = made(3)
    long = warc.record("response", 7, "http://x/" + "u" * 70_000, b"body", hashlib.sha256(b"body").hexdigest(), None, DATE)
    assert salvaged(b"".join([parts[0], long, parts[1]]), False) == ([0, 7, 1], [])
    assert salvaged(b"".join(zlib.compress(x, 5, 31) for x in (parts[0], long, parts[1])), True) == ([0, 7, 1], [])
    # a length beyond the end of the file fails at once, and what follows comes back
    wrong = parts[0].replace(b"Content-Length: ", b"Content-Length: 99999999999", 2)
    ids, gaps = salvaged(wrong + parts[1], False)
    assert ids == [1] and gaps == [(0, len(wrong), "the record is cut off")]
    # a version line that no header follows
    ids, gaps = salvaged(b"WARC/1.1\r\nno colon\r\n" + parts[2], False)
    assert ids == [2] and gaps[0][:2] == (0, 20)


def test_records_of_one_large_member_come_one_at_a_time():
    body = bytes(200_000)
    data = zlib.compress(b"".join(warc.record("response", k, "u", body, "", None, DATE) for k in range(100)), 5, 31)

    class Source(io.BytesIO):
        def read_at(self, n, at):
            return data[at : at + n]

    source = Source()
    for k, x in enumerate(warc.Member(source, 0, len(data))):
        assert x[2]["warc-record-id"] == f"<urn:page:{k}>"
    assert k == 99
    plain, held = warc.Plain(), 0
    for out, last in warc.Member(source, 0, len(data)).text():
        assert len(out) <= warc.CHUNK
        for _ in plain.feed(out, last):
            pass
        held = max(held, len(plain.held))
    assert held < 2 * warc.CHUNK + 400_000


def test_a_record_without_a_digest_in_a_member_whose_check_fails_is_set_aside():
    text = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    good, bad = zlib.compress(text, 5, 31), bytearray(zlib.compress(text, 5, 31))
    bad[-6] ^= 1
    assert salvaged(bytes(bad) + good, True) == ([5], [(0, len(bad), salvaged(bytes(bad), True)[1][0][2])])
