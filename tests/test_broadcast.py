"""Key sets are broadcast only under a bound in bytes, also of long text keys."""

from rowsync.session import BROADCAST_MAX_BYTES, ROW_BYTES, fits_broadcast


def test_bound_counts_text_bytes():
    assert fits_broadcast(0, None) and fits_broadcast(1000, 40_000)
    assert fits_broadcast(BROADCAST_MAX_BYTES // ROW_BYTES)
    assert not fits_broadcast(BROADCAST_MAX_BYTES // ROW_BYTES + 1)
    assert not fits_broadcast(10, BROADCAST_MAX_BYTES)  # few rows, very long ids
