"""Fixed values of the glucose domain and scalar column expressions.

Fixed values (they must equal the reference's for equal results):
  readings are clipped to 39..301 mg/dL;
  vocabulary: reading v in 39..301 -> id v - 39 (0..262); <mask> 263, <pad> 264, <cls> 265;
  older clip rule: below 40 -> 39, above 300 -> 301 (after integer truncation);
  coarse vocabulary: (v - 30) // 10;
  glucose bands: low < 70, in range 70..180 (180 excluded), high >= 180;
  a day has 288 five-minute slots.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
CLIP_LO = 39
CLIP_HI = 301
MASK_ID = 263
PAD_ID = 264
CLS_ID = 265
VOCAB_SIZE = 266
LOW = 70.0
HIGH = 180.0
DAY_SLOTS = 288
SLOT_MINUTES = 5
IGNORE_LABEL = -100
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_missing(x) -> Column:
    """Null or NaN (the reference marks gaps with NaN)."""
    c = _c(x)
    return c.isNull() | F.isnan(c)


def clip_value(x, lo: float = CLIP_LO, hi: float = CLIP_HI) -> Column:
    """Clamp a non-missing reading; missing stays null."""
    c = _c(x)
    return F.when(is_missing(c), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c.cast("double"), F.lit(float(lo))), F.lit(float(hi))))


def clip_by_threshold(x) -> Column:
    """Truncate to int, then below 40 -> 39 and above 300 -> 301."""
    c = _c(x)
    t = F.when(is_missing(c), F.lit(None)).otherwise(c.cast("double").cast("int"))
    return F.when(t < 40, F.lit(39)).when(t > 300, F.lit(301)).otherwise(t)


def encode_value(x) -> Column:
    """E1 + E3 + E4: clip, truncate and map to the fixed vocabulary; missing -> <pad>."""
    c = _c(x)
    return F.when(is_missing(c), F.lit(PAD_ID)).otherwise(
        clip_value(c).cast("int") - F.lit(CLIP_LO))


def decode_token(x) -> Column:
    """Id -> mg/dL reading; special ids -> null."""
    c = _c(x)
    return F.when((c >= 0) & (c <= CLIP_HI - CLIP_LO), c + F.lit(CLIP_LO))


def bucket_value(x, size: int = 10) -> Column:
    """Coarse vocabulary floor((v - 30) / size)."""
    c = _c(x)
    return F.when(~is_missing(c), F.floor((c - F.lit(30)) / F.lit(size)).cast("int"))


def glucose_band(x) -> Column:
    """0 = low (< 70), 1 = in range, 2 = high (>= 180); missing -> null."""
    c = _c(x)
    return (F.when(is_missing(c), F.lit(None).cast("int"))
            .when(c < LOW, F.lit(0)).when(c >= HIGH, F.lit(2)).otherwise(F.lit(1)))


def slot_of(ts) -> Column:
    """5-minute slot of the day (0..287) of a timestamp."""
    t = _c(ts)
    return (F.hour(t) * 12 + F.floor(F.minute(t) / F.lit(SLOT_MINUTES))).cast("int")
