import hashlib
import random
import zlib

import pytest
from fixtures import awkward, frame

from graphloom.llm import media_ts as m


@pytest.mark.parametrize("unit", [300, 16384])
def test_round_trip_at_every_stuffing(unit):
    r = random.Random(1)
    for n in [*range(1, 600), 16383, 16384, 16385, 70_000]:
        p = r.randbytes(n)
        s = m.demux(m.mux(p, unit))
        assert b"".join(u.data for u in s.units) == p
        assert (s.errors, s.discontinuities, s.programs, s.kinds) == (0, 0, {1: m.PMT_PID}, {m.ES_PID: m.PRIVATE_DATA})
        assert [u.pts for u in s.units] == [i * m.TICKS for i in range(-(-n // unit))]
        assert all(u.random_access for u in s.units)


def test_lost_repeated_and_broken_packets():
    p = random.Random(2).randbytes(5000)
    ts = m.mux(p)
    packets = [ts[i : i + 188] for i in range(0, len(ts), 188)]
    lost = m.demux(b"".join(packets[:9] + packets[10:]))
    assert lost.discontinuities == 1
    again = m.demux(b"".join([*packets[:9], packets[8], *packets[9:]]))
    assert again.discontinuities == 0 and again.units[0].data == p
    assert m.demux(ts + b"xyz").errors == 3
    assert m.demux(b"\0" + ts[1:]).programs == {}
    assert m.demux(None).units == [] and m.demux(b"abc").errors == 3
    assert m._time(m._stamp((1 << 33) - 5)) == (1 << 33) - 5


def test_query_columns(spark):
    rows = awkward()
    got = m.digests(m.access_units(m.encode_payloads(frame(spark, rows)))).collect()
    want = []
    for d, t in rows:
        b = (t or "").encode()
        p = b + bytes(64 - len(b) % 64 if len(b) % 64 or not b else 0)
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m.mux(p)), hashlib.sha256(m.mux(p)).hexdigest()))
    assert sorted([tuple(r)[:7] for r in got], key=str) == sorted(want, key=str)
    assert m.digests(m.access_units(m.encode_payloads(frame(spark, [])))).count() == 0


def test_columns_named_like_results_are_passed_on(spark):
    media = m.encode_payloads(frame(spark, [(1, "some text"), (2, None)])).withColumn("units", m.F.lit("own")).withColumnRenamed("media", "payload")
    got = m.access_units(media, "payload")
    assert {"carried_units", "carried_payload", "units", "payload"} <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].carried_units == "own" and bytes(rows[1].payload).rstrip(bytes(1)) == b"some text" and len(rows[2].payload) == 64
