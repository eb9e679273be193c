"""Readers, adapters to the event contract, and table sinks."""
