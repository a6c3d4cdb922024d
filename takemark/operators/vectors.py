"""Names that all operators on takes share. The vectors themselves are in takes."""

from __future__ import annotations

TAKE = ["lesson_id", "take_id"]
#: Cosines are compared with each other, so they are rounded beyond the noise of summation order.
DECIMALS = 12
