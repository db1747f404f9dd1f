"""Part of the lectern package: functions."""
