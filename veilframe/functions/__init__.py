"""Part of the scan engine."""
