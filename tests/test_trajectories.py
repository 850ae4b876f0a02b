"""Binary trajectories written here and read by frame ranges: slices, broken ends, large files, compressed places."""

import random
import struct

import numpy as np
import pytest

from motefield.sources import binary, xtc


class Bits:
    """A stream of bits, the first one highest in its byte."""

    def __init__(self):
        self.text = ""

    def put(self, value, size):
        self.text += format(value, f"0{size}b") if size else ""

    def triple(self, values, radix, size):
        number = (values[0] * radix[1] + values[1]) * radix[2] + values[2]
        while size > 8:
            self.put(number & 255, 8)
            number, size = number >> 8, size - 8
        self.put(number, size)

    def bytes(self):
        text = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def packed(places, small, seed=0):
    """(low, high, bytes): places with runs of steps wherever the next atoms are near, changing widths at random."""
    draw, bits = random.Random(seed), Bits()
    low, high = places.min(axis=0), places.max(axis=0)
    radix = [int(r) for r in high - low + 1]
    apart = max(radix) > xtc.WIDEST
    whole = (radix[0] * radix[1] * radix[2]).bit_length()
    i, run = 0, 0
    while i < len(places):
        half, span = xtc.STEPS[small] // 2, xtc.STEPS[small]

        def chain(k):
            """The first place, then how the atoms from i on follow each other by steps: the second atom is stored first."""
            order = [i + 1, i, *range(i + 2, i + k + 1)]
            line = [order[1], order[0], *order[2:]]
            return all(((0 <= places[b] - places[a] + half) & (places[b] - places[a] + half < span)).all() for a, b in zip(line, line[1:], strict=False)), line

        most = 0
        while i + most + 1 < len(places) and most < 9 and chain(most + 1)[0]:
            most += 1
        # in the stream the whole place is the second atom's, the step's atom comes first
        now = draw.randrange(most + 1) if most else 0
        atoms = [i + 1, i, *range(i + 2, i + now + 1)] if now else [i]
        anchor = atoms[0]
        line = [anchor, *([i] if now else []), *atoms[2:]]
        fits = all(((0 <= places[b] - places[a] + half) & (places[b] - places[a] + half < span)).all() for a, b in zip(line, line[1:], strict=False))
        if not fits:
            now, line, anchor = 0, [i], i
        at = (places[anchor] - low).tolist()
        if apart:
            for value, r in zip(at, radix, strict=True):
                bits.put(value, r.bit_length())
        else:
            bits.triple(at, radix, whole)
        change = draw.choice([0, 0, 0, 1, -1])
        change = change if xtc.FIRST < small + change < 40 else 0
        if now != run or change:
            bits.put(1, 1)
            bits.put(3 * now + change + 1, 5)
        else:
            bits.put(0, 1)
        run = now
        for a, b in zip(line, line[1:], strict=False):
            bits.triple((places[b] - places[a] + half).tolist(), [span] * 3, small)
        small += change
        i += 1 + now
    return low, high, bits.bytes()


def xtc_file(frames, precision=1000.0, small=15, magic=1995):
    out = b""
    for t, xyz in enumerate(frames):
        n = len(xyz)
        head = struct.pack(">3if9fi", magic, n, 10 * t, 0.5 * t, *[3.0, 0, 0, 0, 4.0, 0, 0, 0, 5.0], n)
        if n <= 9:
            out += head + np.asarray(xyz, dtype=">f4").tobytes()
            continue
        low, high, body = packed(np.rint(xyz * precision).astype(np.int64), small, t)
        out += head + struct.pack(">f3i3ii", precision, *low, *high, small) + struct.pack(">q" if magic == 2023 else ">i", len(body)) + body + bytes(-len(body) % 4)
    return out


def water(n, seed=1, spread=2.0):
    draw = np.random.default_rng(seed)
    centers = np.repeat(draw.uniform(0, spread, (-(-n // 3), 3)), 3, axis=0)[:n]
    return centers + draw.uniform(-0.04, 0.04, (n, 3))


@pytest.mark.parametrize("n,spread,small", [(10, 2.0, 12), (100, 2.0, 18), (301, 5.0, 20), (60, 40_000.0, 22), (48, 0.01, 10)])
def test_packed_places_come_back(n, spread, small):
    for seed in range(4):
        places = np.rint(water(n, seed, spread) * 1000).astype(np.int64)
        low, high, body = packed(places, small, seed)
        assert (xtc.decode_positions(body, n, low, high, small) == places).all()


def dcd_file(frames, order="<", boxed=True):
    record = lambda body: struct.pack(order + "i", len(body)) + body + struct.pack(order + "i", len(body))
    out = record(b"CORD" + struct.pack(order + "9if10i", len(frames), 100, 5, 0, 0, 0, 0, 0, 0, 2.0, int(boxed), *[0] * 8, 24))
    out += record(struct.pack(order + "i", 1) + b" " * 80) + record(struct.pack(order + "i", len(frames[0])))
    for xyz in frames:
        if boxed:
            out += record(struct.pack(order + "6d", 30, 90, 40, 90, 90, 50))
        for k in range(3):
            out += record(np.asarray(xyz[:, k], dtype=order + "f4").tobytes())
    return out


def trr_file(frames, wide=False, empty=()):
    out, kind = b"", ">f8" if wide else ">f4"
    for t, xyz in enumerate(frames):
        n, size = len(xyz), 8 if wide else 4
        x = 0 if t in empty else 3 * n * size
        out += struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file" + struct.pack(">10i", 0, 0, 9 * size, 0, 0, 0, 0, x, 3 * n * size, 0) + struct.pack(">3i", n, t, 0)
        out += struct.pack(">2d" if wide else ">2f", 0.25 * t, 0) + np.array([1, 0, 0, 0, 2, 0, 0, 0, 3], dtype=kind).tobytes()
        out += (xyz.astype(kind).tobytes() if x else b"") + np.zeros((n, 3), dtype=kind).tobytes()
    return out


def told(df):
    rows = df.collect()
    return {f: np.array([[r.x, r.y, r.z] for r in sorted((r for r in rows if r.frame == f), key=lambda r: r.atom)]) for f in {r.frame for r in rows}}


@pytest.mark.parametrize("kind", ["dcd", "dcd-big", "trr", "trr-wide", "xtc", "xtc-2023", "xtc-plain"])
def test_slices_ranges_and_broken_ends(spark, tmp_path, kind):
    n = 7 if kind == "xtc-plain" else 40
    frames = [np.round(water(n, s), 3) for s in range(30)]
    name = kind.split("-")[0]
    raw = {
        "dcd": lambda: dcd_file(frames), "dcd-big": lambda: dcd_file(frames, ">", False), "trr": lambda: trr_file(frames), "trr-wide": lambda: trr_file(frames, True),
        "xtc": lambda: xtc_file(frames), "xtc-2023": lambda: xtc_file(frames, magic=2023), "xtc-plain": lambda: xtc_file(frames),
    }[kind]()
    scale = 1 if name == "dcd" else 10
    (tmp_path / "a").write_bytes(raw)
    path = str(tmp_path / "a")
    # ranges far smaller than a frame, of a few frames, and one
    for size in (100, 2000, 1 << 26):
        index = binary.frame_index(spark, path, name, size)
        assert sorted(r.frame for r in index.collect()) == list(range(30))
    cases = [(None, None, 1), (3, 20, 4), (-5, None, 1), (-100, -25, 2), (7, 8, 1), (29, 99, 1), (5, 5, 1)]
    for start, stop, step in cases:
        found = told(binary.read_frames(binary.frame_slice(index, start, stop, step), name, 3000))
        want = list(range(30))[start:stop:step]
        assert sorted(found) == want
        assert all(np.allclose(found[f], frames[f] * scale, atol=1e-4 * scale) for f in want)
    (tmp_path / "b").write_bytes(raw[:-10])
    cut = binary.read_trajectory(spark, str(tmp_path / "b"), name)
    assert sorted(told(cut)) == list(range(29))
    with pytest.raises(ValueError):
        binary.frame_slice(index, step=-1)


def test_frames_without_positions_and_several_files(spark, tmp_path):
    frames = [water(12, s) for s in range(6)]
    (tmp_path / "a.trr").write_bytes(trr_file(frames, empty=(0, 3)))
    (tmp_path / "b.trr").write_bytes(trr_file(frames[:2]))
    found = binary.read_trr(spark, str(tmp_path / "*.trr"))
    times = {(r.file[-5], r.frame): r.time for r in found.select("file", "frame", "time").distinct().collect()}
    assert times == {("a", 0): 0.25, ("a", 1): 0.5, ("a", 2): 1.0, ("a", 3): 1.25, ("b", 0): 0.0, ("b", 1): 0.25}
    (tmp_path / "none.xtc").write_bytes(b"no trajectory at all, but bytes enough to look at, and some more")
    with pytest.raises(Exception, match="no XTC file"):
        binary.read_xtc(spark, str(tmp_path / "none.xtc")).count()


def test_one_frame_of_a_file_above_two_gigabytes(spark, tmp_path):
    path, frame = tmp_path / "large.dcd", np.round(water(1000), 3)
    head = dcd_file([frame])
    header = binary.dcd_header(lambda at, size: head[at : at + size])
    count = (3 << 30) // header.frame
    with open(path, "wb") as f:  # sparse: what is not written takes no disk
        f.write(head)
        f.seek(header.size + (count - 1) * header.frame)
        f.write(head[header.size :])
    assert path.stat().st_size > 2 << 30
    last = binary.read_trajectory(spark, str(path), "dcd", -1)
    assert last.rdd.getNumPartitions() == 1
    found = told(last)
    assert list(found) == [count - 1] and np.allclose(found[count - 1], frame, atol=1e-5)
