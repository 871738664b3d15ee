"""Streams of view events: attestation, dwell segments, live coverage, display gate, reading sessions."""
