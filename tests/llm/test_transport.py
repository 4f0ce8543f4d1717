from __future__ import annotations

import hashlib
import random
import zlib

from fieldloom.llm import transport
from tests.llm.conftest import TEXTS


def test_round_trip_of_all_lengths():
    rng = random.Random(0)
    for n in [*range(0, 400), 183, 184, 185, 11_759, 11_760, 11_761, 11_762, 30_000, 94_144]:
        payload = rng.randbytes(n)
        media = transport.encode(payload)
        s = transport.decode(media)
        assert s.payload == payload and len(media) % 188 == 0 and media[::188] == b"\x47" * (len(media) // 188)
        assert (s.continuity_errors, s.crc_errors, s.damaged) == (0, 0, 0)


def test_time_stamps_and_access_points():
    s = transport.decode(transport.encode(bytes(400_000)))
    assert s.stamps == [3600 * k for k in range(len(s.stamps))]
    assert s.access_points == s.stamps[:: transport.GROUP] and len(s.access_points) > 2
    assert transport._unstamp(transport._stamp((1 << 33) - 1)) == (1 << 33) - 1


def test_faults_are_counted():
    media = transport.encode(bytes(range(256)) * 200)
    lost = media[: 188 * 10] + media[188 * 11 :]
    twice = media[: 188 * 11] + media[188 * 10 :]
    assert transport.decode(lost).continuity_errors == 1
    again = transport.decode(twice)
    assert again.continuity_errors == 1 and again.payload == bytes(range(256)) * 200
    broken = bytearray(media)
    broken[15] ^= 1
    assert transport.decode(bytes(broken)).crc_errors == 1
    assert transport.decode(b"").payload == b"" and transport.decode(b"\0" * 188).damaged == 1
    noise = b"\x47\x1f\xff\x10" + bytes(184)
    assert transport.decode(noise + media + noise).payload == bytes(range(256)) * 200


def test_checksum_of_the_tables():
    # the published check value of this checksum
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_rows(spark, odd_docs, no_docs):
    found = transport.read_media(transport.with_media(odd_docs)).collect()
    want = []
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((repr(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == sorted(want)
    same = [(r["media_sha256"], r["feature"]) for r in found if r["doc_id"] in (1, 2)]
    assert same[0] == same[1]
    again = transport.read_media(transport.stored(odd_docs)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert transport.read_media(transport.stored(no_docs)).count() == 0
