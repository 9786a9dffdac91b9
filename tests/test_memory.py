"""Steps in Python hold few of a batch's texts at once."""

import tracemalloc

import pyarrow as pa

from prosemill.operators import lexer, screen

BATCH = pa.RecordBatch.from_arrays([pa.array(range(4_000)), pa.array([f"{n:05d}" * 2_000 for n in range(4_000)])], names=["k", "text"])  # 40 MB


def peak(rows) -> int:
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_scanned_rows():
    scan = lambda text: [(text,)]
    found = list(lexer.scanned(iter([BATCH]), scan, ["k", "t"], [pa.string()]))
    assert pa.Table.from_batches(found).column("t").to_pylist() == BATCH.column(1).to_pylist() and len(found) > 10
    assert peak(lexer.scanned(iter([BATCH]), scan, ["k", "t"], [pa.string()])) < 8_000_000


def test_scored_texts():
    score = lambda texts: [float(len(t)) for t in texts]
    assert pa.Table.from_batches(screen.scored(iter([BATCH]), score, "k")).to_pydict() == {"k": list(range(4_000)), "p": [10_000.0] * 4_000}
    assert peak(screen.scored(iter([BATCH]), score, "k")) < 4_000_000
