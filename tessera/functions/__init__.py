"""Part of tessera: functions."""
