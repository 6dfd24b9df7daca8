"""Frames of interleaved output, held against a plain walk over each file."""

import random

import pytest

from jobtrail.sources import frames
from jobtrail.sources.frames import read_frames


def frame(stream: int, payload: bytes) -> bytes:
    return bytes([stream, 0, 0, 0]) + len(payload).to_bytes(4, "big") + payload


def walked(data: bytes) -> dict[str, list[bytes]]:
    out, p = {"stdout": b"", "stderr": b""}, 0
    while p + 8 <= len(data) and data[p] <= 2 and data[p + 1 : p + 4] == b"\0\0\0":
        end = p + 8 + int.from_bytes(data[p + 4 : p + 8], "big")
        if end > len(data):
            break
        out["stderr" if data[p] == 2 else "stdout"] += data[p + 8 : end]
        p = end
    lines = {s: x.split(b"\n") for s, x in out.items()}
    return {s: x[:-1] if x[-1] == b"" else x for s, x in lines.items()}


def put(root, job: str, box: str, files: list[bytes]) -> list[tuple]:
    folder = root / f"job_id={job}" / f"container_id={box}"
    folder.mkdir(parents=True)
    lines = {"stdout": [], "stderr": []}
    for i, data in enumerate(files):
        (folder / f"part-{i:03}").write_bytes(data)
        for stream, found in walked(data).items():
            lines[stream] += found
    return [(job, box, s, i, x.decode("utf-8")) for s, found in lines.items() for i, x in enumerate(found)]


def read(spark, root, block_bytes):
    rows = read_frames(spark, str(root), block_bytes).collect()
    return sorted((r.job_id, r.container_id, r.stream, r.line_no, r.line) for r in rows)


def noise(rng: random.Random, frames: int) -> bytes:
    """Frames whose payloads hold newlines, nothing, or bytes that look like headers."""
    out = b""
    for _ in range(frames):
        kind = rng.random()
        if kind < 0.2:
            payload = frame(rng.randrange(3), b"x" * rng.randrange(12))[: rng.randrange(20)]
        elif kind < 0.3:
            payload = b""
        elif kind < 0.4:
            payload = b"\0" * rng.randrange(30)
        else:
            payload = "".join(rng.choice("abé\n \x01\x02") for _ in range(rng.choice([3, 9, 40]))).encode()
        out += frame(rng.randrange(3), payload)
    return out


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "499")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_frames_are_found_at_any_split(spark, tmp_path, tiny_splits, block_bytes):
    rng = random.Random(block_bytes)
    want = []
    for job, files in enumerate([1, 2]):
        want += put(tmp_path, f"j{job}", "c", [noise(rng, frames) for frames in [90, 5][:files]])
    assert read(spark, tmp_path, block_bytes) == sorted(want)


def test_broken_and_empty_files(spark, tmp_path, tiny_splits):
    good = frame(1, b"one\ntw") + frame(2, b"err") + frame(1, b"o\n")
    cases = {
        "cut_payload": good + frame(1, b"never ends\n" * 20)[:-5],
        "cut_header": good + b"\x01\0\0",
        "no_header": good + b"\x07\0\0\0\0\0\0\x01x" + good * 10,
        "nothing": b"",
        "only_newline": frame(2, b"\n"),
        "no_newline": frame(1, b"open") + frame(1, b" end"),
        "long": frame(1, b"a" * 700 + b"\n" + b"b" * 700) + frame(2, b"\n" * 30),
        "plain_text": b"no frames here\n" * 20,
    }
    want = [row for name, data in cases.items() for row in put(tmp_path, name, "c", [data])]
    assert read(spark, tmp_path, 40) == sorted(want)
    assert ("cut_payload", "c", "stdout", 1, "two") in want and not any(r[0] == "plain_text" for r in want)


def test_blocks_reach_python_one_by_one(spark, tmp_path, monkeypatch):
    """A task holds one block and the few places where chains leave it, however many blocks a file has."""
    want = put(tmp_path, "1", "c", [b"".join(frame(1 + i % 2, b"line %d\n" % i) for i in range(5000))])
    seen, chains = spark.sparkContext.accumulator(0), []
    written = frames._written

    def watched(df, name, *more):
        out = written(df, name, *more)
        if name == "frame-chains":
            chains.append((out.where("leaves").count(), out.where("leaves").select("file", "exit").distinct().count(), out.count()))
        return out

    each = frames._each

    def counted(block, *names):
        seen.add(block.num_rows)
        assert block.num_rows == 1
        return each(block, *names)

    monkeypatch.setattr(frames, "_written", watched)
    monkeypatch.setattr(frames, "_each", counted)
    assert read(spark, tmp_path, 512) == sorted(want)
    assert seen.value > 100
    leaving, exits, rows = chains[0]
    assert exits <= leaving < rows / 3
