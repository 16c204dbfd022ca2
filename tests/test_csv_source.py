import csv
import io
import random

import pytest

from wattline.sources import csv_source as op
from wattline.sources.intervals import read_interval_csv


def noisy(rng, n, header):
    """A file whose fields hold commas, quotes, line breaks and long texts."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    w.writerow(header)
    rows = []
    for i in range(n):
        row = [rng.choice(["", "a", "x,y", 'say "so"', "two\nlines", "\n\n", '"', "é☃", "l" * rng.randint(1, 300)]) for _ in header[1:]]
        rows.append([f"r{i}", *row])
        w.writerow(rows[-1])
    return out.getvalue(), rows


@pytest.mark.parametrize("seed", range(4))
def test_ranges_of_any_size_give_each_record_once(tmp_path, seed):
    rng = random.Random(seed)
    text, rows = noisy(rng, 120, ["id", "a", "b"])
    p = tmp_path / "f.csv"
    p.write_bytes(text.encode() if seed else text.encode().rstrip(b"\r\n"))
    size = p.stat().st_size
    for step in (1, 7, 64, 1000, size, size * 2):
        got = []
        for lo in range(0, size, step):
            with open(p, "rb") as f:
                before = op.quotes(f, max(lo - 1, 0))
                got += list(op.fields(op.records(f, lo, min(lo + step, size), before)))
        assert got == [["id", "a", "b"], *rows]


def test_files_with_their_own_headers(spark, tmp_path):
    rng = random.Random(9)
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "sub").mkdir()
    want = {}
    for name, header in (("a.csv", ["id", "one", "two"]), ("sub/b.csv", ["id", "two", "x", "one"]), ("c.csv", ["id", "one"])):
        text, rows = noisy(rng, 300, header)
        (tmp_path / name).write_text(("﻿" if name == "a.csv" else "") + text + "\n \n", newline="")
        for r in rows:
            d = dict(zip(header, r))
            want[name.split("/")[-1], d["id"]] = tuple(d.get(c) or None for c in ("one", "two"))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("id,one\n")
    h = {"id": "id", "one": "one", "two": "two"}
    for size in (200, None):
        df = read_interval_csv(spark, str(tmp_path), headers=h, range_bytes=size)
        got = {(r.file_name, r.id): (r.one, r.two) for r in df.collect() if r.id and r.id.strip()}
        assert got == want
        assert df.select("site_id", "file_name").distinct().count() >= 3
    assert read_interval_csv(spark, f"{tmp_path}/*.csv", headers=h).where("id like 'r%'").count() == 900
    assert read_interval_csv(spark, f"file://{tmp_path}/c.csv", headers=h).where("id like 'r%'").count() == 300


def test_the_number_of_ranges_does_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "MOST_RANGES", 8)
    rng = random.Random(9)
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_bytes(noisy(rng, 200, ["id", "a", "b"])[0].encode())
    options = {"path": str(tmp_path), "headers": '{"x": "id", "y": "a"}', "rangebytes": "64"}
    source = op.HeadedCsv(options)
    reader = op.Reader(source.schema(), options)
    parts = reader.partitions()
    assert len(parts) <= 8 + 3
    ids = [v for p in parts for b in reader.read(p) for v in b.column(1).to_pylist()]
    assert sorted(ids) == sorted(f"r{i}" for i in range(200) for _ in range(3))
