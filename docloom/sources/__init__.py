"""Files, web pages and sinks."""
