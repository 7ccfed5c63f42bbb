"""Part of the property-price analytics package: functions."""
