"""Windows over event streams (an extension: the batch operators know availability dates, not watermarks)."""

from quillon.streaming.windows import drain, session_totals, sliding_totals, tumbling_totals

__all__ = ["drain", "session_totals", "sliding_totals", "tumbling_totals"]
