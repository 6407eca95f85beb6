"""Fixed values of the monitor. These decide results, so they live in one place."""

MIN_VOLUME = 30
Z = 1.96
FAMILY_ALPHA = 0.05
DELTA_PP_DEFAULT = 3.0
PERSISTENCE_WINDOWS = 3
THIN_CELL_WINDOW_MIN = 5
HISTORY_MIN = 120
ONSET_LOOKBACK_MIN = 120

BEAM_WIDTH = 4
MAX_DEPTH = 3
SELECTION_TOLERANCE = 0.02
MAX_CAUSES_PER_ROOT = 3

MIN_DECLINES = 20
DECLINE_WINDOWS_MIN = (1, 5, 15)
TEMPORAL_MIN_DECLINES = 100
DECLINE_CURRENT_LOOKBACK_MIN = 15
DECLINE_HISTORY_LOOKBACK_MIN = 360
OUTAGE_CODES = ("91", "AB03")

RESOLVE_AFTER_QUIET_MIN = 3
RECALL_LIMIT = 3
GRACE_SECONDS = 10
RETENTION_MIN = 180
RECENT_BUCKETS = 60
RATE_BEFORE_FIRST = 0.9

# The five dimensions of the cube, and the three left free under a root.
DIMS = ("merchant_id", "provider_id", "country", "payment_method", "issuer_id")
FREE_DIMS = ("provider_id", "payment_method", "issuer_id")
ROOT_DIMS = ("merchant_id", "country")
MEASURES = ("attempts", "approved", "amount_minor_sum", "amount_usd_sum", "approved_usd_sum")

# Names used inside cell keys, in key order.
KEY_NAMES = (
    ("country", "country"),
    ("issuerId", "issuer_id"),
    ("merchantId", "merchant_id"),
    ("paymentMethod", "payment_method"),
    ("providerId", "provider_id"),
)

CURRENCY_BY_COUNTRY = {"BR": "BRL", "MX": "MXN", "AR": "ARS"}

# Rows of one time block never exceed one day of minutes plus the look-back.
BLOCK_MIN = 1440
