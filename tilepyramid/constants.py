"""Fixed values of the tile grid.  They must equal the published grid for results to match."""

from __future__ import annotations

TILE = 256
TILE_CELLS = TILE * TILE
MERCATOR_RADIUS = 6378137.0

# World extent in EPSG:3857 metres.  The grid origin is (WORLD_MIN_X, WORLD_MAX_Y).
WORLD_MIN_X = -20026376.39
WORLD_MAX_X = 20026376.39
WORLD_MIN_Y = -20048966.10
WORLD_MAX_Y = 20048966.10

# Metres per cell for zoom 0..15.
RESOLUTIONS = (
    156543.033928,
    78271.516964,
    39135.758482,
    19567.879241,
    9783.939621,
    4891.969810,
    2445.984905,
    1222.992453,
    611.496226,
    305.748113,
    152.874057,
    76.437028,
    38.218514,
    19.109257,
    9.554629,
    4.777314,
)

# The percent-clip bounds of the 8-bit stretch.
CLIP_LOW = 0.02
CLIP_HIGH = 0.98

EXTENT_SEPARATOR = " "
DEFAULT_BANDS = (1,)
SUPPORTED_EPSG = (4326, 3857)
