"""gridloom: geospatial sampling, compositing and embedding evaluation on Spark."""
