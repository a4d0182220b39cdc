"""Hyper-parameter values of the detectors (inventory DET21).

Fixed values; they equal the published grid of the benchmark.  Learning rates and layer widths of neural models
have no meaning here and are left out; the bottleneck width is the rank.
"""

GRID = {
    "IForest": {"trees": [25, 50, 100, 150, 200], "max_features": [0.2, 0.4, 0.6, 0.8, 1.0]},
    "LOF": {"n_neighbors": [10, 20, 30, 40, 50], "metric": ["minkowski", "manhattan", "euclidean"]},
    "PCA": {"components": [0.25, 0.5, 0.75, None]},
    "HBOS": {"n_bins": [5, 10, 20, 30, 40], "tol": [0.1, 0.3, 0.5, 0.7]},
    "OCSVM": {"kernel": ["linear", "rbf"], "nu": [0.1, 0.3, 0.5, 0.7]},
    "MCD": {"support": [0.2, 0.4, 0.6, 0.8, None]},
    "KNN": {"n_neighbors": [10, 20, 30, 40, 50], "method": ["largest", "mean", "median"]},
    "KMeansAD": {"n_clusters": [10, 20, 30, 40], "window_size": [10, 20, 30, 40]},
    "COPOD": {},
    "CBLOF": {"n_clusters": [4, 8, 16, 32], "alpha": [0.6, 0.7, 0.8, 0.9]},
    "EIF": {"trees": [25, 50, 100, 200]},
    "RobustPCA": {"max_iter": [500, 1000, 1500]},
    "AutoEncoder": {"rank": [32, 16, 64]},
    "CNN": {"window": [50, 100, 150]},
    "LSTMAD": {"window": [50, 100, 150]},
    "TranAD": {"window": [5, 10, 50]},
    "AnomalyTransformer": {"window": [50, 100, 150]},
    "OmniAnomaly": {"window": [5, 50, 100]},
    "USAD": {"window": [5, 50, 100]},
    "Donut": {"window": [60, 90, 120]},
    "TimesNet": {"window": [32, 96, 192]},
    "FITS": {"window": [100, 200]},
    "OFA": {"window": [50, 100, 150]},
}

BEST = {
    "IForest": {"trees": 25, "max_features": 0.8},
    "LOF": {"n_neighbors": 50, "metric": "euclidean"},
    "PCA": {"components": 0.25},
    "HBOS": {"n_bins": 30, "tol": 0.5},
    "OCSVM": {"kernel": "rbf", "nu": 0.1},
    "MCD": {"support": 0.8},
    "KNN": {"n_neighbors": 50, "method": "mean"},
    "KMeansAD": {"n_clusters": 10, "window_size": 40},
    "COPOD": {},
    "CBLOF": {"n_clusters": 4, "alpha": 0.6},
    "EIF": {"trees": 50},
    "RobustPCA": {"max_iter": 1000},
    "CNN": {"window": 50},
    "LSTMAD": {"window": 150},
    "TranAD": {"window": 10},
    "AnomalyTransformer": {"window": 50},
    "OmniAnomaly": {"window": 100},
    "USAD": {"window": 100},
    "Donut": {"window": 60},
    "TimesNet": {"window": 96},
    "FITS": {"window": 100},
    "OFA": {"window": 50},
}
