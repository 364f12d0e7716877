"""Engine settings, broadcast bounds and plan checks."""
