"""duskline: Spark-native analytics for dense sensor networks.

Readings are cleaned, aligned to local nights and to sunset, folded into
station-by-night panels, and studied with rank statistics, dependence-aware
resampling, panel models, spatial interpolation and rank-based screens.
Every operator takes and returns DataFrames.
"""

from duskline.session import get_session

__all__ = ["get_session"]
