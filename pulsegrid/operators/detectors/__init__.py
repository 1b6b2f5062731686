from pulsegrid.operators.detectors.base import Detector, PandasDetector, RowDetector, SCORE_COLUMNS

__all__ = ["Detector", "PandasDetector", "RowDetector", "SCORE_COLUMNS"]
