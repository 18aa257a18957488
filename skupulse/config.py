"""Fixed values shared by operators and queries.

These constants must equal the reference's for results to agree.
Fixed values: thresholds, cost constants, split sizes and windows.
"""

import datetime as _dt

# Series flags
SPARSITY_THRESHOLD = 0.70
CV_THRESHOLD = 0.10

# Cost constants (per transfer hour, per holding day, per short unit)
TRANSFER_COST_K = 0.0008
HOLDING_COST_H = 0.00055
SHORTAGE_COST_U = 0.07

# Model selection thresholds
MAX_SELECT_WAPE = 0.45
MAX_SELECT_ABS_BIAS = 0.15

# Split sizes (distinct dates)
TRAIN_DAYS = 24
TEST_DAYS = 7

# Window of the fixture data used as the one-month demand study.
WINDOW_START = _dt.date(1998, 3, 1)
WINDOW_END = _dt.date(1998, 3, 31)
TRAIN_START = _dt.date(1998, 3, 1)
TRAIN_END = _dt.date(1998, 3, 24)
TEST_START = _dt.date(1998, 3, 25)
TEST_END = _dt.date(1998, 3, 31)
VALID_START = _dt.date(1998, 3, 18)
VALID_END = _dt.date(1998, 3, 24)

# Click events live in a different calendar; shifted by whole days onto the
# order window (2024-01-01 -> 1998-03-01).
CLICK_EPOCH = _dt.date(2024, 1, 1)

# Default route time when no route has a known lead time (hours).
DEFAULT_ROUTE_HOURS = 24.0
INNER_TRAIN_END = _dt.date(1998, 3, 17)
