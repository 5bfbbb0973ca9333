"""Formats: containers, codecs, media, and the sinks that write them."""
