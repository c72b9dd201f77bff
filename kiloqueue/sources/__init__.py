"""Sources and sinks: input adapter, readers and writers."""
