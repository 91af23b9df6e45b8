"""Part of tessera: streaming."""
