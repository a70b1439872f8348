"""Continuous input: chunked mining of a stream, and the online engine with keyed state."""
