"""Fixed analysis values.

Every number here must equal the published analysis settings for results to
agree, so they are stated plainly and in one place.
"""

import math

# -- fixed values: stain vectors (optical-density direction per dye) ----------
HEMATOXYLIN = (0.650, 0.704, 0.286)
EOSIN = (0.072, 0.990, 0.105)

# -- fixed values: tissue mask ------------------------------------------------
MASK_BLUR_UM = 2.0
OPENING_UM = 4.0
CLOSING_UM = 8.0
SMALLEST_TISSUE_UM2 = 500.0
OTSU_BINS = 256

# -- fixed values: orientation field -----------------------------------------
DERIVATIVE_TAPS = (0.109604, 0.276691, 0.0, -0.276691, -0.109604)
PREFILTER_TAPS = (0.037659, 0.249153, 0.426375, 0.249153, 0.037659)
DERIVATIVE_BLUR_UM = 2.0
TENSOR_BLUR_UM = 12.0
COHERENCY_FLOOR = 0.20
CROSSING_CEILING = 0.35
BETA_CEILING = 0.5 * math.log(3.0)

# -- fixed values: mesh -------------------------------------------------------
MESH_SPACINGS_UM = (4.0, 8.0, 16.0)
MESH_NODE_BUDGET = 2_000_000

# -- fixed values: candidate ranges ------------------------------------------
RANGE_LOW_UM = 16.0
RANGE_HIGH_UM = 512.0
RANGES_PER_OCTAVE = 8
FEWEST_RANGES = 9

# -- fixed values: covariance model ------------------------------------------
NUGGET_LOW, NUGGET_HIGH = 0.05, 0.95
START_FRACTIONS = (0.15, 0.35, 0.5, 0.7, 0.9)
START_NUGGETS = (0.25, 0.10, 0.35, 0.60, 0.85)
DENSE_LIMIT = 2000
NEIGHBOURS = 30
GRID_PHI_POINTS = 16
GRID_NUGGETS = (0.05, 0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.90, 0.95)
BOOTSTRAP_DRAWS = 9999
RANK_TOLERANCE = 1e-10

# -- fixed values: molecular quality and eligibility --------------------------
QC_UMI, QC_GENES, QC_MITO = 500, 200, 0.20
GENE_MIN_OBS, GENE_MIN_FRACTION = 10, 0.001
SOURCES_NEEDED = 20
SOURCE_COUNTS_NEEDED = 25
RECEIVERS_NEEDED = 30
STATE_FRACTION_NEEDED = 0.10
STATE_SIZE_NEEDED = 30

# -- fixed values: evidence ---------------------------------------------------
ANISOTROPY_MULTIPLIERS = (0.5, 1.0, 1.5)
SATURATION_LEVELS = (0.25, 0.5, 1.0, 2.0, 4.0)
RANGE_SPREAD_BITS = 1.0
MESH_SHIFT_BITS = 0.5
SPECIFICITY_R2 = 0.01
CALIBRATION_SCALE, CALIBRATION_POWER = 0.6589, 0.7998
CONTACT_RADIUS_FACTOR = 1.5

# -- fixed values: range reporting (bits either side of the estimate) ---------
SHORT_RANGE_UM = 64.0
SHORT_BAND = {0.90: 1.312, 0.95: 1.750}
SHORT_UPPER = {0.90: 0.875, 0.95: 1.500}
LONG_UPPER = {0.90: 1.000, 0.95: 1.250}
