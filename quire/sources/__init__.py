"""Decoders and encoders: bytes and grammars to flat rows and back."""
