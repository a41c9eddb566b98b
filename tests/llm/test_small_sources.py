"""Sources too small for a queue are spread over the stream."""

from collections import defaultdict

import pytest

from sourcetrust.llm import packing
from test_token_operators import check_pieces, packed

SOURCES = 100


@pytest.mark.parametrize("broadcast", [packing.BROADCAST_ROWS, 0])
def test_small_sources_are_spread(spark, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast)
    rows = [(i, "the cat sat", f"s{i % SOURCES:03}", "x") for i in range(20 * SOURCES)]
    rows += [(10000 + i, "the cat sat on it " * 9, "large", "x") for i in range(150)]
    got = packed(spark, rows, sequence=32, window_sequences=4)
    check_pieces(rows, got, 32)
    at = defaultdict(list)
    for r in got:
        at[r.source].append(r.sequence_id)
    last = max(r.sequence_id for r in got)
    assert all(max(at[s]) - min(at[s]) > 0.4 * last for s in at)


def test_small_sources_advance_in_proportion(spark):
    """However small, a source's documents come at the share of the stream that lies before them in it."""
    rows = [(i, "w " * 50, "ab"[i % 2], "x") for i in range(60)] + [(100, "w", "tiny", "x"), (101, None, "tiny", "x")]
    rows += [(200 + i, "w", f"few{i % 3}", "x") for i in range(24)]
    got = packed(spark, rows, sequence=32, window_sequences=4)
    check_pieces(rows, got, 32)
    assert {r.source for r in got} == {"a", "b", "tiny", "few0", "few1", "few2"}
    at = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        if r.source.startswith("few"):
            at[r.source].append(r.sequence_id)
    last = max(r.sequence_id for r in got)
    assert all(len(v) >= 8 and v[-1] - v[0] > 0.5 * last for v in at.values())
