"""slicelake: PySpark analytics over archives of medical image slices."""
