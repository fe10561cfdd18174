"""Raster tile pyramids as lazy Spark plans."""

from tilepyramid.operators.mosaic import mosaic, unpack
from tilepyramid.operators.overlap import scene_tile_pairs, scenes_per_tile
from tilepyramid.plans.pyramid import build_pyramid, pyramid_report, tile_cells

__all__ = ["build_pyramid", "mosaic", "pyramid_report", "scene_tile_pairs", "scenes_per_tile",
           "tile_cells", "unpack"]
