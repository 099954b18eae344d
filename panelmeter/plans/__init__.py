from .evaluation import evaluate, evaluate_runs, run_spread  # noqa: F401
from .held_out import evaluate_left_out_raters, evaluate_two_way, macro  # noqa: F401
from .reliability import noise_ceiling, split_half, split_table  # noqa: F401
