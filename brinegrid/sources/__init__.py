"""Tables from configuration files, GeoJSON and raster bands, and sinks."""
