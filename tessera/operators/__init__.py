"""Part of tessera: operators."""
