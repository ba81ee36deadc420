"""What a Python worker holds is bounded in bytes, not in rows."""

import pyarrow as pa

from timelode.operators import memory, products
from timelode.sources import image_files


def test_batches_are_cut_by_their_texts():
    texts = ["a" * 300, None, "", "é" * 600, "b" * 5000, "c"] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(24)), pa.array(texts, pa.string())], names=["i", "text"])
    parts = list(memory.slices(batch, 1, 1600))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 1600 for p in parts) and len(parts) > 8
    assert list(memory.slices(batch.slice(0, 0), 1)) == []
    memory.give_back()


def test_files_are_read_in_batches_of_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(image_files, "BATCH", 1000)
    for i in range(20):
        (tmp_path / f"f{i:02}").write_bytes(bytes([i]) * 300)
    names = [f"f{i:02}" for i in range(20)]
    batches = list(image_files.Reader(f"file://{tmp_path}").read(image_files.Names(names)))
    assert [b.num_rows for b in batches] == [4] * 5
    assert [(n, c) for b in batches for n, c in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True)] == [(n, bytes([i]) * 300) for i, n in enumerate(names)]


def test_runs_of_products_are_bounded_by_their_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1_500_000] * 7)], names=["own"])
    assert [r.num_rows for r in products._runs(batch, 4, "own")] == [2, 2, 2, 1] and [r.num_rows for r in products._runs(batch, 4)] == [7]
