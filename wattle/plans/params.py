"""Fixed parameters of the registered queries (shared by the Spark and SQL sides)."""

WINDOW = 26            # hours per point: the day plus one margin hour on each side
MAX_SHIFT = 1          # shifts -1, 0, +1 hour
WRAP_SHIFT = 3         # shifts beyond the margin of a point wrap around
POOL = 100             # seed centroids sampled from the points
K_FIT = 5              # clusters for the single-K queries
MAX_ITERS = 100        # bound of every fit; convergence stops it long before
DELTA = 1e-4           # convergence: no centroid moved more than this
SWEEP_START, SWEEP_END = 2, 10
LEAST_COVERAGE = 0.50  # K sweep stops at the first K reaching this coverage
ENTROPY_BINS = 10
ENTROPY_THRESHOLD = 1.0  # meters at or below are "predictable"
TOP_TAGGED = 10
SLICE_FIRST, SLICE_LAST = "2024-01-10", "2024-01-19"  # date range read from the table by day
DIGITS = 6             # doubles are rounded to this many decimals in query outputs

# generator
SYNTH_DAYS = 7
SYNTH_START = "2024-02-01"
PEAKY_RATIO = 1.5
SYNTH_SEED = 7
SYNTH_HOURS_PER_TASK = 2_000_000  # generated rows of one task
