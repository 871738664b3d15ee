"""Part of slicelake."""
