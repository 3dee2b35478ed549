"""Match telemetry analytics as plain DataFrame -> DataFrame operators."""
