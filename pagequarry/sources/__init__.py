"""Collections and other inputs and outputs."""
