"""Part of brindle: functions."""
