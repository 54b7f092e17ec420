"""labelforge: a Spark-native engine for collecting, cleaning and judging
training labels (fusion, verdict parsing, quota selection, splitting,
banding, calibration and evaluation as DataFrame / Column operators)."""

__version__ = "0.1.0"
