"""Quality metrics of scores and labels, for all series in one job (inventory MET1-MET18)."""

from .affiliation import affiliation, affiliation_f
from .points import best_f1, event_f1, point_adjusted_f1, pointwise, recall_precision
from .ranges import auc_ptrt, range_f1, range_fbeta, range_scores
from .report import bulk, full_report, prediction_report, scalar_report
from .vus import range_auc, vus, vus_pred

__all__ = [
    "affiliation", "affiliation_f", "auc_ptrt", "best_f1", "bulk", "event_f1", "full_report", "point_adjusted_f1",
    "pointwise", "prediction_report", "range_auc", "range_f1", "range_fbeta", "range_scores", "recall_precision",
    "scalar_report", "vus", "vus_pred",
]
