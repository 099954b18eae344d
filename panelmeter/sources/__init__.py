from .panel import (read_features, read_item_types, read_panel, read_predictions)  # noqa: F401
from .frames import FRAME_SCHEMA, read_commands, read_frames  # noqa: F401
from .sinks import (bundle_runs, materialise, write_run, write_windows)  # noqa: F401
