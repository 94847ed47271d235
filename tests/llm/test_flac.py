import random

import pytest

from skein.llm import flac

from .helpers import ODD, clash, frame


def payloads():
    rng = random.Random(4)
    kinds = [lambda: rng.randrange(256), lambda: 65, lambda: rng.randrange(97, 122), lambda: rng.choice([0, 255]), lambda: rng.choice([128] * 40 + [0])]
    out = [bytes(k() for _ in range(192 * n)) for k in kinds for n in (1, 2, 7)]
    out.append(bytes(128 + int(60 * __import__("math").sin(i / 9)) for i in range(192 * 5)))
    out.append(bytes(i % 256 for i in range(192 * 300)))
    return out


def test_round_trip():
    got = flac.encode(payloads())
    assert flac.decode(got) == payloads() and [flac.decode([s])[0] for s in got] == payloads()
    assert flac.encode([]) == [] and flac.decode([]) == []


def test_a_stream_does_not_depend_on_its_neighbours():
    assert flac.encode(payloads()) == [flac.encode([p])[0] for p in payloads()]


def test_predictors_shorten():
    wave = payloads()[-2]
    assert len(flac.encode([wave])[0]) < len(wave) * 0.8


def test_damage_is_found():
    payload = payloads()[8]
    whole, rng, found = flac.encode([payload])[0], random.Random(8), 0
    for _ in range(400):
        stream = bytearray(whole)
        stream[rng.randrange(len(stream))] ^= 1 << rng.randrange(8)
        try:
            assert flac.decode([bytes(stream)]) == [payload]  # sizes and the like aren't needed to decode
        except flac.FlacError:
            found += 1
    assert found > 320
    for cut in (3, 10, 50, len(whole) // 2, len(whole) - 1):
        with pytest.raises(flac.FlacError):
            flac.decode([whole[:cut]])


def subframe(bits: str, number: int = 0) -> bytes:
    import numpy as np

    head = bytes([0xFF, 0xF8, 0x14, 0x02, number])
    head += bytes([int(flac._crc(np.frombuffer(head, np.uint8), np.array([0]), np.array([5]), flac._CRC8, 8)[0])])
    bits += "0" * (-len(bits) % 8)
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac._crc(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), flac._CRC16, 16)[0])
    return body + crc.to_bytes(2, "big")


def rice(values, k):
    out = ""
    for v in values:
        u = v << 1 if v >= 0 else (-v << 1) - 1
        out += "0" * (u >> k) + "1" + (format(u & (1 << k) - 1, f"0{k}b") if k else "")
    return out


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("form", ["one", "parts", "wide", "escape"])
def test_frames_that_the_encoder_does_not_make(order, form):
    import numpy as np

    rng = random.Random(order)
    x = np.cumsum([rng.randint(-2, 2) for _ in range(192)]).clip(-100, 100).astype(int)
    r = np.diff(x, n=order).tolist()
    bits = "0" + format(8 + order, "06b") + "0" + "".join(format(int(v) & 255, "08b") for v in x[:order])
    if form == "one":
        bits += "00" + "0000" + "0010" + rice(r, 2)
    elif form == "wide":
        bits += "01" + "0000" + "00001" + rice(r, 1)
    elif form == "escape":
        bits += "00" + "0000" + "1111" + "01100" + "".join(format(v & 4095, "012b") for v in r)
    else:
        bits += "00" + "0010"
        for i in range(4):
            part = r[max(0, 48 * i - order) : 48 * i + 48 - order]
            bits += format(i, "04b") + rice(part, i)
    got, end = flac._frames(flac._Bits(subframe(bits) + bytes(8)), np.array([0]), np.array([0]))
    assert got[0].tolist() == x.tolist() and end[0] == len(subframe(bits))


def test_long_linear_predictor():
    import numpy as np

    taps, shift = [5, -3, 2, 1, -1, 2, 1], 3
    rng = random.Random(9)
    r = [rng.randint(-3, 3) for _ in range(192 - 7)]
    x = [1, -2, 3, 0, 1, 2, -1]
    for v in r:
        x.append(v + (sum(t * x[-1 - i] for i, t in enumerate(taps)) >> shift))
        assert -128 <= x[-1] < 128
    bits = "0" + format(32 + 6, "06b") + "0" + "".join(format(v & 255, "08b") for v in x[:7]) + format(4, "04b") + format(shift, "05b") + "".join(format(t & 31, "05b") for t in taps)
    got, _ = flac._frames(flac._Bits(subframe(bits + "00" + "0000" + "0001" + rice(r, 1)) + bytes(8)), np.array([0]), np.array([0]))
    assert got[0].tolist() == x


def test_columns(spark):
    media = flac.to_media(clash(frame(spark, ODD)))
    got = {r.doc_id: r for r in flac.media_features(media).collect()}
    blocks = {}
    for r in sorted(flac.pcm_blocks(media).collect()):
        blocks[r.doc_id] = blocks.get(r.doc_id, b"") + r.pcm
    for i, t in enumerate(ODD):
        b = (t or "").encode()
        want = flac.pad(b)
        assert len(want) % 192 == 0 and want and got[i].n_bytes == len(b) and got[i].payload_bytes == len(want) and blocks[i] == want
        assert got[i].payload_sha256 == __import__("hashlib").sha256(want).hexdigest() and got[i].tail_crc32 == __import__("zlib").crc32(want[-16:])
    assert got[4].feature == got[5].feature and got[4].media_sha256 == got[5].media_sha256
    assert flac.media_features(flac.to_media(frame(spark, []))).count() == 0
