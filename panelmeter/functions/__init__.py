from .logistic import (binary_entropy, clamp, log_loss, logit, sig, sig_sql, spread)  # noqa: F401
from .grid import GRID_SIZE, NODE_COUNT, ability_grid, ability_prior, difficulty_nodes  # noqa: F401
from .draws import hash_int, hash_uniform, hash_int_sql  # noqa: F401
