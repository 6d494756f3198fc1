"""Structured Streaming form of the upload job."""
