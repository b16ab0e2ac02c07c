"""A sensitive-data scan engine for PySpark; see README.md."""

from .operators.scan import CustomRule, ScanConfig, scan, scan_array

__all__ = ["CustomRule", "ScanConfig", "scan", "scan_array"]
