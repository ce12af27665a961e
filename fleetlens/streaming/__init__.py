"""Structured Streaming forms of the digest, sessions, checks, samples, merges and roll-ups."""
