from .ability import answered_so_far, outcome_changes, running_pass_rate, track_ability, track_loglik  # noqa: F401
from .sinks import drain, latest_per_key, next_item_writer  # noqa: F401
from .windows import event_windows  # noqa: F401
