"""Finding, reading and parsing log files."""
