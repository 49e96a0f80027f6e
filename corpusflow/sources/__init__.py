"""Readers: files with content hashes, paper catalogues in XML and JSON, event-stream frames."""
