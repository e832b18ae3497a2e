"""The event operators over streams."""
