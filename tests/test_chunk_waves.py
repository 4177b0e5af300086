"""Files of chunks are written and listed in waves, with the same files as in one job."""

import pytest

from logloom.operators import packing

GROUPS = ["web", "a=b/c %1", "007", "x[1]{2}*?", None]


@pytest.mark.parametrize("files", [3, 1000])
def test_waves_write_the_same_files(spark, tmp_path, files):
    rows = [(g, i, f"{i} {'x' * (i % 9)}\n") for i, g in enumerate(GROUPS * 8)]
    df = spark.createDataFrame(rows, "g string, i long, line string")
    chunks = packing.chunk_bytes(df, 25, "g", ["i"], "line")
    out = str(tmp_path / "out")
    packing.write_chunks(df, chunks, out, "g", ["i"], "line", files=files)
    sizes = packing.written_sizes(chunks, out, "g", files=files)
    want = {}
    for r in chunks.join(df, (chunks.i == df.i)).select(chunks.g, "file_name", "line").collect():
        key = (r.g or None, r.file_name)
        want[key] = want.get(key, 0) + len(r.line)
    got = {}
    for r in sizes.collect():
        got[(r.g, r.file_name)] = got.get((r.g, r.file_name), 0) + r.n_bytes
    assert got == want
    lines = [x for p in (tmp_path / "out").rglob("part-*") for x in p.read_text().splitlines() if not p.name.endswith(".crc")]
    assert sorted(lines) == sorted(t[:-1] for _, _, t in rows)


def test_a_wave_lists_its_own_folders(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("g", i, "0123456789\n") for i in range(40)], "g string, i long, line string")
    chunks = packing.chunk_bytes(df, 11, "g", ["i"], "line")
    out, seen = str(tmp_path / "out"), []
    packing.write_chunks(df, chunks, out, "g", ["i"], "line", files=10)
    reader = type(spark.read)
    real = reader.load

    def load(self, path=None, *rest, **named):
        seen.append(len(path))
        return real(self, path, *rest, **named)

    monkeypatch.setattr(reader, "load", load)
    assert packing.written_sizes(chunks, out, "g", files=10).count() == 40
    assert len(seen) > 1 and sum(seen) == 40 and max(seen) < 30
