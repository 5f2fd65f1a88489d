"""The same decoders over a stream of arriving files."""
