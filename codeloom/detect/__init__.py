"""Detectors: what one file's syntax tree and text say, as facts. engine.facts() runs them over a table of files."""
