"""dockpulse: bike-share station telemetry analytics as plain Spark DataFrame functions."""
