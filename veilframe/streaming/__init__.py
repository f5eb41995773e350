"""Streaming forms: extras of this library."""
