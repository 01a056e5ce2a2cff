"""Spectra of a batch are taken a few series at a time."""

import numpy as np
import pyarrow as pa
import pytest

from daybook.operators import spectra


def test_spectra_are_taken_a_few_series_at_a_time():
    rng = np.random.default_rng(2)
    series = [rng.normal(size=n).tolist() for n in [2, 3, 30, 31, *[12] * 600]]
    ids, n = pa.array(range(len(series)), pa.int64()), pa.array(map(len, series), pa.int32())
    batch = pa.RecordBatch.from_arrays([ids, n, pa.array(series)], ["series_id", "n", "x"])
    pieces = list(spectra._powers([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in pieces) <= spectra.SERIES_AT_A_TIME and sum(p.num_rows for p in pieces) == len(series)
    for x, power in zip(series, [p for piece in pieces for p in piece.column("power").to_pylist()], strict=True):
        whole = np.abs(np.fft.fft(np.array(x) - np.mean(x))) ** 2 / len(x)
        half = whole[1 : len(x) // 2 + 1] * 2
        half[-1] /= 2 if len(x) % 2 == 0 else 1
        assert power == pytest.approx(half.tolist(), abs=1e-9)
