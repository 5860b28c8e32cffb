"""Default thresholds (fixed values, which results depend on)."""

TEST_SIZE, VAL_SIZE, SEED = 0.2, 0.1, 42
HIGH_CARDINALITY, HIGH_CORRELATION, NEAR_ZERO_VARIANCE, QUASI_CONSTANT = 50, 0.85, 0.01, 0.99
LOW_IV, HIGH_VIF, LEAKAGE, MAX_NULL_RATE = 0.02, 10.0, 0.95, 0.8
PSI_FLAG, PSI_BINS, CSI_FLAG = 0.25, 10, 0.2
IV_BINS, HIGH_MISSING, IQR_FACTOR, Z_LIMIT = 10, 0.3, 1.5, 3.0
SKEW_ALERT, ZEROS_ALERT, IMBALANCE_ALERT = 1.0, 0.05, 0.5
IMPUTE_SKEW, WOE_CLIP, SMOOTHING, INDICATOR_RATE = 0.5, 4.0, 10.0, 0.05
WINSOR, MAD_LIMIT, RARE_FREQUENCY, RARE_TOP = 0.01, 3.5, 0.01, 10
HASH_COMPONENTS, EPSILON = 8, 1e-8
MAX_CLASSES, MIN_OOT, MAX_RATE_GAP = 20, 50, 0.05
QUANTILES, KNOTS, SPLINE_DEGREE, COMPONENTS, NOISE, NOISE_ROWS, PERMUTATIONS, ROUNDS = 1000, 5, 3, 10, 0.05, 0.05, 10, 10
LEAKAGE_AUC, RANDOM_AUC, OVERFIT_GAP, PSI_WATCH, ECE_GAIN = 0.99, 0.55, 0.10, 0.10, 0.001
BALANCED, RED_MISSING = (0.35, 0.65), 0.5
