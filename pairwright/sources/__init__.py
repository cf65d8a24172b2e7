"""Readers, dictionary decoding, codecs and the append-only sink."""
