"""Streams: rate limits with state, rules over token streams, windows over events."""
