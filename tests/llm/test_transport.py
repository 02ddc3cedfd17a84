import random

import pytest

from termloom.llm import transport as T


def sample(n=40, seed=1):
    rng = random.Random(seed)
    units = [T.Unit(T.META_PID, b"en")]
    for i in range(n):
        size = rng.choice([0, 1, 150, 157, 158, 159, 164, 165, 166, 170, 182, 183, 184, 185, 1000, 5000])
        pts = None if i % 7 == 6 else 2**33 - 20000 + 3600 * i
        units.append(T.Unit(T.TEXT_PID, rng.randbytes(size), pts, None if i % 3 else pts and pts - 1800, i % 5 == 0))
    return units


def same(a, b):
    return (a.pid, a.payload, a.random_access) == (b.pid, b.payload, b.random_access) and all((x is None) == (y is None) and (x is None or x % 2**33 == y) for x, y in ((a.pts, b.pts), (a.dts, b.dts)))


def by_pid(units):
    return sorted(units, key=lambda u: u.pid)


TYPES = {T.TEXT_PID: 6, T.META_PID: 0x15}


def test_round_trip():
    units = sample() + [T.Unit(T.TEXT_PID, b"z" * 200_000, 5, None, True)]
    data = T.mux(units, TYPES, program=7)
    s = T.read(data)
    assert len(data) % 188 == 0 and s.packets == len(data) // 188
    assert s.programs == {7: T.PMT_PID} and s.types == {T.TEXT_PID: (7, 6), T.META_PID: (7, 0x15)}
    assert len(s.units) == len(units) and all(same(a, b) for a, b in zip(by_pid(units), s.units))
    assert all(u.continuous for u in s.units) and not (s.gaps or s.duplicates or s.bad_tables or s.skipped_bytes)


def test_lost_packet_breaks_one_unit_only():
    units = [T.Unit(T.TEXT_PID, bytes([i]) * 900, 3600 * i, None, True) for i in range(10)]
    data = T.mux(units, {T.TEXT_PID: 6})
    packets = [data[i : i + 188] for i in range(0, len(data), 188)]
    media = [i for i, p in enumerate(packets) if (p[1] & 31) << 8 | p[2] == T.TEXT_PID]
    s = T.read(b"".join(p for i, p in enumerate(packets) if i != media[14]))
    assert s.gaps == 1 and [u.continuous for u in s.units] == [i != 2 for i in range(10)]
    first = [i for i in media if packets[i][1] & 0x40][2]
    s = T.read(b"".join(p for i, p in enumerate(packets) if i != first))  # that unit is lost, its neighbours are whole
    assert s.gaps == 1 and len(s.units) == 9 and all(u.continuous and len(u.payload) == 900 for u in s.units)


def test_damage():
    units = sample()
    data = T.mux(units, TYPES)
    packets = [data[i : i + 188] for i in range(0, len(data), 188)]
    again = b"".join(p + p if i % 3 == 0 else p for i, p in enumerate(packets))
    s = T.read(again)
    assert s.duplicates and not s.gaps and len(s.units) == len(units)
    s = T.read(b"\x47\x00junk" + data + b"\x47tail")
    assert s.skipped_bytes == 11 and all(same(a, b) for a, b in zip(by_pid(units), s.units))
    assert len(T.read(data[:188] + b"noise" * 7 + data[188:]).units) == len(units)
    flagged = bytearray(data)
    flagged[1] |= 0x80
    assert T.read(bytes(flagged)).errors == 1
    spoiled = bytearray(data)
    spoiled[188 + 10] ^= 1  # in the first program map; the next one counts
    s = T.read(bytes(spoiled))
    assert s.bad_tables == 1 and len(s.units) < len(units) and s.units
    locked = bytearray(data)
    for i in range(0, len(data), 188):
        if (locked[i + 1] & 31) << 8 | locked[i + 2] == T.META_PID:
            locked[i + 3] |= 0x80
    s = T.read(bytes(locked))
    assert s.scrambled == 1 and len(s.units) == len(units) - 1


def test_table_over_several_packets():
    types = {0x100 + i: 6 for i in range(60)}
    units = [T.Unit(pid, bytes([pid & 255]) * 10, 1) for pid in types]
    s = T.read(T.mux(units, types))
    assert len(s.types) == 60 and len(s.units) == 60


def test_checksum():
    assert T.crc32(b"123456789") == 0x0376E6E7


@pytest.mark.parametrize("data", [b"", b"\x47", b"\0" * 1000, b"\x47" * 500, bytes(188)])
def test_no_stream(data):
    assert T.read(data).units == []


def test_random_bytes_don_t_crash():
    rng = random.Random(9)
    base = T.mux(sample(10), TYPES)
    for _ in range(200):
        data = bytearray(base)
        for _ in range(20):
            data[rng.randrange(len(data))] = rng.randrange(256)
        T.read(bytes(data[: rng.randrange(len(data))]))


def test_column_gives_the_texts_back(docs, prose):
    rows = [(i, t, "en") for i, (_, t, *_) in enumerate(prose)]
    got = T.demux(T.film(docs(rows)), payload=True).filter(f"pid = {T.TEXT_PID}").orderBy("doc_id", "unit").collect()
    back = {}
    for r in got:
        back[r.doc_id] = back.get(r.doc_id, "") + bytes(r.payload).decode()
        assert r.continuous and r.pts == 90000 + 3600 * r.unit and r.random_access == (r.unit % 8 == 0)
    assert back == {i: t for i, t, _ in rows if t}


def test_nulls_and_none(spark, docs):
    assert T.demux(T.film(docs([]))).count() == 0
    got = T.demux(T.film(docs([(None, "a", None), (1, None, "en"), (2, "", "en"), (2, "", "en")]))).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.pid) for r in got) == [(-1, 256), (-1, 257), (2, 257), (2, 257)]
    media = spark.createDataFrame([(1, None), (2, b""), (3, b"none")], "doc_id bigint, media binary")
    assert T.demux(media).count() == 0
