"""Spark-native engine for sparse eQTL summary statistics."""

from .dataset import Dataset
from .functions.regions import Region
from .operators.queries import by_gene, by_probe, by_snp, cis_window, cis_windows, probe_range, snp_range

__version__ = "0.1.0"
__all__ = [
    "Dataset",
    "Region",
    "by_gene",
    "by_probe",
    "by_snp",
    "cis_window",
    "cis_windows",
    "probe_range",
    "snp_range",
]
