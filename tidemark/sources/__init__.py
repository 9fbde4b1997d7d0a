"""Sources and sinks: payloads, nested exports, merges and partition replacement."""
