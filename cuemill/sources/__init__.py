"""Sources and sinks: subtitle files and state files."""
