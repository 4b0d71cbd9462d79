"""mosaiq: planar-scene mosaics and corpus preparation as Spark dataflows."""
