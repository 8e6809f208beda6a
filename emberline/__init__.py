"""Spark jobs over daily climate-model grids: catalog, harmonisation, fire-weather and vapour-pressure extremes."""
